import random

import numpy as np
import pytest
from gleanix.llm import truncation as X
from pyspark.sql import functions as F

NOUNS = ["canal", "harbor", "lantern", "bridge", "meadow", "orchard", "granite", "kettle", "saddle", "timber", "valley", "wagon"]
ADJECTIVES = ["slow", "early", "narrow", "quiet", "hollow", "modern", "bitter", "shallow"]


def _sentence(rng):
    a, b, c = (rng.choice(NOUNS) for _ in range(3))
    return rng.choice([f"The {a} of the {b} is kept with a {rng.choice(ADJECTIVES)} {c}.", f"In the {a}, a {rng.choice(ADJECTIVES)} {b} is added to the {c}, e.g. for the {a}.", f"Some {a} is moved for approx. {rng.randrange(9, 99)} hours in a {b}."])


def _corpus(n=900):
    rng = random.Random(6)
    rows, cases = [], set()
    for i in range(n):
        text = " ".join(_sentence(rng) for _ in range(rng.randrange(3, 9)))
        kind = i % 9
        source = "web"
        if kind == 0:
            text = f"how to move the {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)}"
            source = "log"
        elif kind == 1:
            text += "\n\nYou need:\n" + "\n".join(f"- {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)}" for _ in range(3))
        elif kind == 2:
            text += rng.choice(["\n-- Miller", "\nCheers, Miller", " Well, who knows...", " And so on …", " (End of notice)"])
        elif kind == 3 and i % 2:
            at = rng.choice([k for k in range(60, len(text) - 20) if text[k - 1] not in ".,"])
            text = text[:at]
            if not text.rstrip().endswith("."):
                cases.add(i)
        elif kind == 4 and i % 2:
            text = text[: text.index(" e.g.") + 5] if " e.g." in text else text
            if text.endswith("e.g."):
                cases.add(i)
        elif kind == 5 and len(text) > 200:
            text, source = text[:200], "short"
            if not text.endswith("."):
                cases.add(i)
        rows.append((i, text, None, source, len(text), None, None))
    return rows, cases


def test_found_on_planted_cuts(spark, tables):
    rows, cases = _corpus()
    data = tables(extra="src,kind,cut,unit,mark", documents=rows)
    got = {r.doc_id for r in X.found(spark, data).collect()}
    assert len(got & cases) / len(cases) > 0.93
    assert len(got - cases) / len(got) < 0.03
    rates = {r.source: r for r in X.rates(spark, data).collect()}
    assert sum(r.truncated for r in rates.values()) == len(got) and rates["log"].rate == 0.0


def test_dirty_rows_and_empty_tables(spark, tables):
    rows = [(1, None, None, None, None, None, None), (2, "", None, "", 0, None, None), (3, " \n ", None, "x", 3, None, None), (4, "word " * 60_000 + "end.", None, "x", 0, None, None), (5, "...", None, "x", 3, None, None), (None, "cut of", None, "x", 6, None, None), (6, "Same text.", None, "x", 0, None, None), (7, "Same text.", None, "y", 0, None, None), (8, "…", None, "x", 1, None, None)]
    data = tables(documents=rows)
    assert {r.doc_id for r in X.found(spark, data).collect()} <= {5, 8}
    assert {r.source: r.documents for r in X.rates(spark, data).collect()} == {"": 2, "x": 5, "y": 1}
    empty = tables()
    assert X.found(spark, empty).collect() == X.rates(spark, empty).collect() == []


@pytest.mark.parametrize(
    "short, expected",
    [
        ("one two three four five six sev", True),
        ("one two three four five six", True),
        ("one two three four five six seven.", None),
        ("one two three four five", None),
        ("one two three four five six seven. Eight", True),
        ("a b c d e f g", None),
        ("", None),
    ],
)
def test_align(short, expected):
    long = "one two three four five six seven. Eight nine."
    assert X.align(short, long) is (expected if short != "one two three four five six seven." else False)


WORDS = [f"w{k}" for k in range(60)]


@pytest.mark.parametrize(
    "short, long, expected",
    [
        (WORDS[:37] + ["x"] + WORDS[38:40], WORDS, True),
        (WORDS[:37] + ["x"] + WORDS[37:40], WORDS, True),
        (WORDS[:37] + WORDS[38:40], WORDS, True),
        (WORDS[:39] + ["harbur"], WORDS[:39] + ["harbour"] + WORDS[40:], True),
        (WORDS[:38] + ["x", "harb"], WORDS[:39] + ["harbour"], True),
        (WORDS[:38] + ["x", "harbour."], WORDS[:39] + ["harbour.", "One", "more."], False),
        (WORDS[:38] + ["x", "w39"], WORDS[:40], None),
        (WORDS[:39] + ["x"], WORDS, None),
        (WORDS[:40], WORDS + WORDS[34:39] + ["end."], True),
        (WORDS[:30] + WORDS[:30], WORDS[:30] + WORDS[:27] + ["x"] + WORDS[28:30], None),
        (WORDS[:40], WORDS + WORDS[15:40], True),
    ],
)
def test_align_with_edits_and_repeats(short, long, expected):
    assert X.align(" ".join(short), " ".join(long)) is expected


def test_edits_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        tail, text = rng.choices("abc", k=rng.choice([5, 10])), rng.choices("abc", k=rng.randrange(25))
        column, expected = list(range(len(tail) + 1)), [len(tail)]
        for w in text:
            old, column = column, [0]
            for i, t in enumerate(tail):
                column.append(min(old[i] + (t != w), old[i + 1] + 1, column[i] + 1))
            expected.append(column[-1])
        assert list(X._edits(tail, text)) == expected


def test_a_cut_copy_is_found_by_its_whole_copy(spark, tables):
    """The cut falls after a word that often ends a text of this kind, so only the copy can tell."""
    rng = random.Random(1)
    words = [f"term{k}" for k in range(400)]
    whole = " ".join(rng.choices(words, k=120))
    rows = [(0, whole, None, "log", 0, None, None), (1, " ".join(whole.split()[:110]), None, "log", 0, None, None)]
    rows += [(i, " ".join(rng.choices(words, k=30)), None, "log", 0, None, None) for i in range(2, 60)]
    assert {r.doc_id for r in X.found(spark, tables(documents=rows)).collect()} == {1}


def test_copies_cut_anywhere_are_found_by_their_whole(spark, tables):
    """Cut after 110 to 30 of 120 words, always behind a word that often ends a text of this kind."""
    rng = random.Random(12)
    words = [f"term{k}" for k in range(400)]
    texts, cases = [], set()
    for n in (110, 100, 90, 60, 30):
        whole = rng.choices(words, k=120)
        texts += [whole, whole[:n]]
        cases.add(len(texts) - 1)
    texts += [rng.choices(words, k=30) for _ in range(60)]
    rows = [(i, " ".join(t), None, "log", 0, None, None) for i, t in enumerate(texts)]
    assert {r.doc_id for r in X.found(spark, tables(documents=rows)).collect()} == cases


def test_recall_of_the_bands_on_edited_cut_copies():
    """Against brute force over the same pairs: copies cut anywhere, one word in forty changed, that verify when compared."""
    rng = np.random.default_rng(3)
    met = real = 0
    for _ in range(600):
        whole = rng.integers(0, 2**63, int(rng.integers(40, 500))).astype(np.uint64)
        copy = whole[: int(rng.integers(20, len(whole)))].copy()
        copy[rng.random(len(copy)) < 1 / 40] = 1
        s, t = (set(X.shingle_hashes(x).tolist()) for x in (whole, copy))
        if X._similar(s, t):
            real += 1
            a, b = X.band_keys(whole), X.band_keys(copy)
            met += bool((a[: min(len(a), len(b))] == b[: min(len(a), len(b))]).any())
    assert real > 450 and met >= 0.97 * real


@pytest.mark.parametrize("word, expected", [("ab" * 30, True), ("ab" * 50, True), ("cd" * 30, False)])
def test_beginnings_of_long_words(spark, word, expected):
    stats = spark.createDataFrame([("word", "ab" * 60, 5), ("word", "ab" * 30 + "x", 1), ("word", "cd" * 30, 7)], "kind STRING, key STRING, a BIGINT")
    alone = spark.createDataFrame([(word, 1)], "closing STRING, n_word BIGINT")
    got = {r.closing: r.n_longer for r in X._prefixes(stats, alone).where(F.col("closing") == word).collect()}
    assert got == ({word: 5} if expected else {})


@pytest.mark.parametrize("block", [256, 7])
def test_a_cut_copy_is_found_among_longer_texts_of_its_bucket(spark, tables, monkeypatch, block):
    """Many texts share most words, so that the longest of a bucket is seldom the original; one cut copy is longer than its original."""
    monkeypatch.setattr(X, "BLOCK", block)
    rng = random.Random(2)
    words = [f"t{k:04}" + "e" * (k % 7) for k in range(4000)]
    shared, texts, cases = rng.choices(words, k=200), [], set()
    for k in range(40):
        whole = shared + rng.choices(words, k=rng.randrange(10, 21))
        texts += [whole, whole[: -rng.randrange(1, 6)]]
        cases.add(2 * k + 1)
    whole = rng.choices(words, k=200)
    texts += [whole, whole[:90] + rng.choices(words, k=9) + whole[90:-4]]
    cases.add(len(texts) - 1)
    texts += [rng.choices(words, k=30) for _ in range(60)]
    rows = [(i, " ".join(t), None, "log", 0, None, None) for i, t in enumerate(texts)]
    assert {r.doc_id for r in X.found(spark, tables(documents=rows)).collect()} == cases


@pytest.mark.parametrize("cut", ["The orchard of the valley is kept with a shallow canal near the old...", "how to move the quiet harb"])
def test_copies_of_a_cut_text_do_not_vouch_for_it(spark, tables, cut):
    """A third of all rows are one cut text, its copies also more than the uses of the word in which it may be cut."""
    rng = random.Random(4)
    texts = [" ".join(_sentence(rng) for _ in range(3)) for _ in range(60)]
    texts += [f"how to move the {a} {n}" for a in ADJECTIVES[:5] for n in NOUNS] + [cut] * 60
    rows = [(i, t, None, "web" if i % 2 else "log", 0, None, None) for i, t in enumerate(texts)]
    assert {r.doc_id for r in X.found(spark, tables(documents=rows)).collect()} == set(range(120, 180))


def test_limits_need_neither_round_lengths_nor_many_texts(spark):
    rng = random.Random(5)
    rows = [("a", rng.randrange(60, 400)) for _ in range(20)] + [("a", 140)] * 4 + [("b", 281)] * 20 + [("b", n) for n in range(200, 360)]
    rows += [("c", 8190)] * 2 + [("c", n) for n in (5000, 6100, 9500)] + [("d", 4000)]
    rows += [("e", 26)] * 40 + [("e", n) for n in (24, 25, 27, 28) for _ in range(30)]
    rows += [("g", 200 + k) for k in range(-5, 6) for _ in range(6 - abs(k))]
    df = spark.createDataFrame([(src, n, bytes([i // 256, i % 256])) for i, (src, n) in enumerate(rows)], "src STRING, n_chars INT, digest BINARY")
    same = spark.createDataFrame([("f", 300, b"x")] * 50, df.schema)
    expected = {("a", 140), ("b", 281), ("c", 8190)}
    assert {(r.src, r.n_chars) for r in X.limits(df.union(same)).collect()} == expected | {("", n) for _, n in expected}


def test_bands_find_near_copies():
    rng = np.random.default_rng(0)
    found = 0
    for _ in range(200):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = a.copy()
        b[rng.choice(300, 6, replace=False)] = 1  # similarity of the shingles about 0.82
        found += bool((X.band_keys(a)[: X.BANDS] == X.band_keys(b)[: X.BANDS]).any())
    assert found >= 196


def test_units():
    assert list(X.units("One is. Two, e.g. this is No. 4. Three\n- a b\n\n-- Miller")) == [("One", "One is."), ("&", "Two, e.g. this is No. 4."), ("&", "Three"), ("-", "- a b"), ("--", "-- Miller")]
