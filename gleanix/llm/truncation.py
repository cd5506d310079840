"""Problem 9: texts cut off by a field limit or a broken transfer."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanix.llm.packing import clean_source
from gleanix.operators.skew import join_stats
from gleanix.session import cut, spread
from gleanix.sources.tables import table

SHINGLE = 5
BANDS, ROWS = 8, 3
#: Openings of so many words have bands of their own, in which a text meets copies that are cut anywhere behind them.
OPENINGS, OPENING_BANDS, OPENING_ROWS = (16, 32, 64), 3, 2
THRESHOLD = 0.8
#: Texts of a bucket that one group holds of each of its two blocks, about.
BLOCK = 256
#: Texts of the groups that are compared in one call, about.
LOT = 1024
#: Ids that are broadcast at most: 8 MB.
FEW_IDS = 1_000_000
#: Letters up to which all beginnings of a word are listed.
HEAD = 32
#: Whole words before the closing one that are laid along another text, at most; one edit fewer is allowed than they have runs of five.
TAIL = 20

_RANDOM = np.random.default_rng(20231)
_MULTIPLIERS = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SENTENCES = re.compile(r"(?<=[.!?…])[\"”»)]*\s+(?![0-9a-zà-öø-ÿ])")
#: Stands for the first token of a sentence that follows another one on its line.
_AFTER = "&"
#: Added to the first token of a unit of eight words or more.
_LONG, _LONG_BLANKS = "\t", 7
_CONTINUED = re.compile(r"(\S+[.)])[ \n]+(?=[0-9a-zà-öø-ÿ])")
_NUMBER = re.compile(r"\d+")
_CLOSED = (".", "!", "?", "…", ")", '"', "”", "»", "'", "’", "]", ":)")
_STRIP = ".,;:!?…()[]{}\"'“”«»‘’¿¡-*•"


class _Hashes(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of the whole where there are fewer."""
    if len(words) == 0:
        return words
    k = min(SHINGLE, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ words[i : len(words) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _least(shingles: np.ndarray) -> np.ndarray:
    """The minimum of the shingles under each of the random multipliers."""
    if len(shingles) <= 4096:
        return (shingles[:, None] * _MULTIPLIERS).min(0)
    return np.array([(shingles * m).min() for m in _MULTIPLIERS])


def _fold(least: np.ndarray, bands: int, rows: int, seed: np.ndarray) -> np.ndarray:
    """Keys of shape (..., bands) from minima of shape (..., rows * bands)."""
    keys = np.repeat(seed[..., None], bands, -1)
    for r in range(rows):
        keys = (keys ^ least[..., r::rows]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys


def band_keys(words: np.ndarray) -> np.ndarray:
    """Keys of the bands of minima of a text's hashed words; equal keys in a band make two texts candidates.

    BANDS of the whole text, then OPENING_BANDS of each of the OPENINGS that it
    has: a cut copy shares the openings with its whole, however much is lost.
    """
    shingles = shingle_hashes(words)
    with np.errstate(over="ignore"):
        keys = _fold(_least(shingles), BANDS, ROWS, np.zeros((), np.uint64))
        openings = [n for n in OPENINGS if len(words) >= n]
        if not openings:
            return keys
        some = shingles[: openings[-1] - SHINGLE + 1, None] * _MULTIPLIERS[: OPENING_BANDS * OPENING_ROWS]
        least = np.stack([some[: n - SHINGLE + 1].min(0) for n in openings])
        return np.concatenate([keys, _fold(least, OPENING_BANDS, OPENING_ROWS, np.array(openings, np.uint64)).ravel()])


_SCAN = "kind STRING, key STRING, a BIGINT, b BIGINT, doc_id BIGINT, mark STRING, start STRING, closing STRING, bands ARRAY<BIGINT>"


def units(text: str) -> Iterator[tuple[str, str]]:
    """(first token, unit) of every sentence of every line."""
    for line in text.split("\n"):
        line = line.strip()
        if line:
            parts = _SENTENCES.split(line)
            yield parts[0].split(None, 1)[0], parts[0]
            for part in parts[1:]:
                if part:
                    yield _AFTER, part


def ending(start: str, unit: str) -> tuple[str, str, str]:
    """(mark, start, closing) of a text's last unit.

    mark: 'dots' for an ellipsis, with the closing word before it; 'stop' for
    another closing mark, with the raw closing token (numbers alike); 'open' for none, with the
    bare closing word.
    """
    tokens = unit.split()
    if unit.endswith(("...", "…")):
        words = [w for t in tokens[-2:] if (w := t.strip(_STRIP).lower())]
        return "dots", start, words[-1] if words else ""
    if unit.endswith(_CLOSED):
        return "stop", start, _NUMBER.sub("9", tokens[-1])
    return "open", start, tokens[-1].strip(_STRIP).lower() or tokens[-1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, raw, ends, carried, starts, closed, dots, last = _Hashes(), Counter(), Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
    for batch in batches:
        ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
        rows: list[list] = [[] for _ in range(5)]
        for text in texts:
            text = text or ""
            tokens = text.split()
            raw.update(tokens)
            carried.update(_CONTINUED.findall(text))
            start, unit, before = "", "", None
            for start, unit in units(text):
                if before is not None:
                    ends[before] += 1
                    before = None
                long = start + _LONG if unit.count(" ") >= _LONG_BLANKS else start
                starts[long] += 1
                if unit.endswith(_CLOSED):
                    closed[long] += 1
                    if unit.endswith(("...", "…")):
                        dots[unit] += 1
                else:
                    before = unit.rsplit(None, 1)[-1].strip(_STRIP).lower()
            if before is not None:
                ends[before] += 1
                last[before] += 1
            words = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
            keys = band_keys(words).view(np.int64) if len(words) else np.zeros(0, np.int64)
            mark, start, closing = ending(start + _LONG if unit.count(" ") >= _LONG_BLANKS else start, unit) if unit else ("void", "", "")
            for column, v in zip(rows, (mark, start, closing, keys, unit if mark == "dots" else None)):
                column.append(v)
        n = len(ids)
        yield _batch(pa.array(["doc"] * n), pa.array(rows[4], pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3], pa.list_(pa.int64())))
    seen, final, stops, goes_on = Counter(), Counter(ends), Counter(), Counter()
    for token, n in carried.items():
        goes_on[_NUMBER.sub("9", token)] += n
    for token, n in raw.items():
        if token.endswith((".", ")")) and (key := _NUMBER.sub("9", token)) in goes_on:
            stops[key] += n
        word = token.strip(_STRIP).lower()
        if word:
            seen[word] += n
            if token.endswith(_CLOSED):
                final[word] += n - min(n, carried[token])
    yield _stats("word", seen, final)
    yield _stats("stop", stops, goes_on)
    yield _stats("start", starts, closed)
    yield _stats("dots", dots, dots)
    yield _stats("last", last, last)


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in _SCAN.split(", ")])


def _stats(kind: str, n: Counter, k: Counter) -> pa.RecordBatch:
    keys = list(n)
    m = len(keys)
    none = lambda t: pa.nulls(m, t)
    return _batch(pa.array([kind] * m, pa.string()), pa.array(keys, pa.string()), pa.array([n[x] for x in keys], pa.int64()), pa.array([k[x] for x in keys], pa.int64()), none(pa.int64()), none(pa.string()), none(pa.string()), none(pa.string()), none(pa.list_(pa.int64())))


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of distinct texts -> a written table with one row a text and the corpus counts, all from one reading of the whole texts.

    Counts leave a task already summed: of each word how often it occurs and how
    often it closes a sentence or line ('word'); of each token with a full stop
    how often the sentence goes on after it ('stop'); of each first token of a
    sentence or line how often that ends with a closing mark ('start'); of each
    unit that ends with an ellipsis how often it occurs word for word ('dots');
    of each word how often it closes a text that has no closing mark ('last').
    """
    return cut(documents.select("doc_id", "text").mapInArrow(_scan, _SCAN), "scan")


def one_each(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, src, text) -> the written ids (doc_id, src, n_chars, digest), the written classes of equal texts (digest, id, n), and (doc_id, text) of the smallest id of each.

    A null text equals the empty one.  The ids left out are usually few, so that
    they are joined without shuffling texts.
    """
    text = F.coalesce("text", F.lit(""))
    ids = cut(documents.select("doc_id", "src", F.length(text).alias("n_chars"), F.unhex(F.md5(text)).alias("digest")), "ids")
    classes = cut(ids.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    copied = classes.where("n > 1")
    total = copied.agg(F.sum("n")).first()[0] or 0
    again = cut(join_stats(ids.select("doc_id", "digest"), copied, "digest", "n", total).where("doc_id <> id").select("doc_id"), "again")
    return ids, classes, spread(documents.select("doc_id", "text")).join(again, "doc_id", "left_anti")


def _surprise(n: Column, k: Column, share: Column) -> Column:
    """A lower bound (Chernoff's) of minus the logarithm of the chance that ``k`` or more of ``n`` are of a kind with that share, or, where k / n lies under it, ``k`` or fewer."""
    part = lambda x, p: F.when(x > 0, x * F.ln(x / (n * p))).otherwise(F.lit(0.0))
    return part(k, share) + part(n - k, 1 - share)


def limits(texts: DataFrame, chance: float = 0.01, above: float = 5.0) -> DataFrame:
    """(src, n_chars, digest) of unclosed texts -> (src, n_chars, at_limit) of the lengths at which a source has far more of them than at the lengths around it.

    The lengths around are a tenth of the length, two at least, to either side.
    Given one text of a length, the others there must be more than chance lets
    any of the source's lengths have, and the mean around be exceeded ``above``
    times, as must that of the nearest eight to either side (a narrow hill of
    lengths is no limit).  Copies of a text count once a source.  Texts without a source may have met any source's limit.
    """
    source = Window.partitionBy("src")
    counts = texts.select("src", "n_chars", "digest").distinct().groupBy("src", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.withColumn("n_lengths", F.count(F.lit(1)).over(source)).withColumn("w", F.expr("greatest(2, n_chars div 10)")).withColumn("v", F.expr("least(8, w)")), "lengths")
    points = F.expr("array(struct(n_chars AS at, n, 0 AS of, 0 AS far, 0 AS close), struct(n_chars + w AS at, 0L AS n, n_chars AS of, 1 AS far, 0 AS close), struct(n_chars - w - 1 AS at, 0L AS n, n_chars AS of, -1 AS far, 0 AS close), struct(n_chars + v AS at, 0L AS n, n_chars AS of, 0 AS far, 1 AS close), struct(n_chars - v - 1 AS at, 0L AS n, n_chars AS of, 0 AS far, -1 AS close))")
    upto = counts.select("src", F.explode(points).alias("p")).select("src", "p.*").withColumn("upto", F.sum("n").over(source.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)))
    around = upto.where("far <> 0 OR close <> 0").groupBy("src", F.col("of").alias("n_chars")).agg(F.sum(F.col("far") * F.col("upto")).alias("total"), F.sum(F.col("close") * F.col("upto")).alias("near"))
    wide, next_to = (F.expr(f"n_chars + {w} - greatest(1, n_chars - {w})").cast("double") for w in "wv")
    many = (F.col("n") > 1) & (F.col("n") >= F.lit(above) * (F.col("total") - F.col("n")) / wide) & (F.col("n") >= F.lit(above) * (F.col("near") - F.col("n")) / next_to)
    found = counts.join(around, ["src", "n_chars"]).where(many & (_surprise(F.col("total") - 1, F.col("n") - 1, 1 / (wide + 1)) >= F.ln(F.col("n_lengths") / F.lit(chance))))
    return found.select("src", "n_chars").unionByName(found.select(F.lit("").alias("src"), "n_chars")).distinct().withColumn("at_limit", F.lit(True))


def align(short: str, long: str) -> bool | None:
    """Whether ``short`` ends early, inside a word or sentence, when laid along ``long``; null where they do not align at its end.

    The last 5, 10, 15 or 20 whole words before the closing one are laid along
    every place of ``long`` with 0, 1, 2 or 3 words changed, lost or added.  Of several
    places the one with fewest edits counts, where one TAIL's length of distance
    from the same place in ``short`` weighs as an edit.
    """
    return _laid(short.split(), long.split())


def _tail(n: int) -> int:
    """Words of the tail of a text of ``n`` words."""
    return min((n - 1) // SHINGLE * SHINGLE, TAIL) if n else 0


def _edits(tail: list[str], b: list[str]) -> Iterator[int]:
    """For every place in ``b``, its start and end included, the least edits of ``tail`` when it ends there (Myers' bit vectors)."""
    at: dict[str, int] = {}
    for i, w in enumerate(tail):
        at[w] = at.get(w, 0) | 1 << i
    full, top, edits = (1 << len(tail)) - 1, 1 << len(tail) - 1, len(tail)
    more, less = full, 0
    yield edits
    for w in b:
        same = at.get(w, 0)
        v, h = same | less, ((same & more) + more ^ more) | same
        up, down = less | ~(h | more) & full, more & h
        edits += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        more, less = down | ~(v | up) & full, up & v
        yield edits


def _one_edit(a: str, b: str) -> bool:
    i = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _closes(word: str, rest: list[str]) -> tuple[int, bool | None]:
    """(edits, whether the text ends early) for a closing word where the other text goes on with ``rest``."""
    if not rest:
        return 1, None
    same = rest[0] == word
    if not same and rest[0].startswith(word):
        return 0, True
    if same or len(word) > 3 and word[-1] == rest[0][-1] and _one_edit(word, rest[0]):
        return int(not same), None if len(rest) == 1 else not word.endswith(_CLOSED) or rest[1][:1].islower()
    return 1, None


def _laid(a: list[str], b: list[str]) -> bool | None:
    m = _tail(len(a))
    if not m:
        return None
    best, early = None, None
    for j, edits in enumerate(_edits(a[-1 - m : -1], b)):
        if edits < m // SHINGLE:
            more, found = _closes(a[-1], b[j : j + 2])
            away = abs(j + 1 - len(a))
            place = (edits + more + away // TAIL, away)
            if best is None or place < best:
                best, early = place, found
    return early


def _similar(s: set[int], t: set[int]) -> bool:
    """Whether the smaller text's shingles are in the other, but for one in five: a cut copy lacks what the whole goes on with."""
    return len(s & t) >= THRESHOLD * min(len(s), len(t))


def compare(texts: list[str], bands: list[list[int]], band: int, blocks: list[int]) -> list[bool | None]:
    """Of each text whether it ends early along any of the others, longer or shorter; null where it aligns with none that is a near-copy.

    Texts align only where the other holds one of the tail's runs of five words
    unchanged, so partners are looked up by these.  A pair that shares an earlier band is left to that; two blocks
    are only compared with each other.
    """
    hashes = _Hashes()
    words = [t.split() for t in texts]
    hashed = [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in words]
    sets = [set(shingle_hashes(h).tolist()) for h in hashed]
    anchors = [shingle_hashes(h[-1 - m : -1])[::SHINGLE].tolist() if (m := _tail(len(h))) else [] for h in hashed]
    wanted = {h for x in anchors for h in x}
    holders = defaultdict(list)
    for y, s in enumerate(sets):
        for h in s & wanted:
            holders[h].append(y)
    two, verdicts = len(set(blocks)) > 1, []
    for x, keys in enumerate(anchors):
        verdict = None
        for y in sorted({y for h in keys for y in holders[h]}):
            if x == y or two and blocks[x] == blocks[y] or any(p == q for p, q in zip(bands[x][:band], bands[y][:band])):
                continue
            early = _laid(words[x], words[y])
            if early is not None and early is not verdict and _similar(sets[x], sets[y]):
                verdict = early
                if early:
                    break
        verdicts.append(verdict)
    return verdicts


def _compared(lot: pd.DataFrame) -> pd.DataFrame:
    """Compares within each of the lot's groups of (bucket, low, high)."""
    lot = lot.sort_values(["bucket", "low", "high"], kind="stable")
    keys = lot[["bucket", "low", "high"]].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])).tolist()
    texts, bands, band, block = (lot[c].tolist() for c in ("text", "bands", "band", "block"))
    verdicts: list[bool | None] = []
    for i, j in zip(starts, [*starts[1:], len(lot)]):
        verdicts += compare(texts[i:j], bands[i:j], int(band[i]), block[i:j])
    return pd.DataFrame({"id": lot["id"].to_numpy(), "cut": pd.Series(verdicts, dtype=object)}).dropna()


def near_copies(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, cut) for texts that have a verified near-copy along which they align: whether they end early.

    Texts that share a band of min-hashes are candidates,
    every one with every other: a bucket is dealt to blocks of about BLOCK
    texts, and each two blocks meet in a group of their own, so that no task
    holds a large bucket.  Pairs of which the smaller text's five-word shingles
    are in the other to less than 0.8 are dropped.
    """
    members = docs.where("size(bands) > 0").select(F.col("doc_id").alias("id"), "bands", F.posexplode("bands").alias("band", "key")).select("id", "bands", "band", F.xxhash64("band", "key").alias("bucket"))
    shared = cut(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    members = join_stats(members, shared, "bucket", "n", total).withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = cut(members.withColumn("block", F.pmod(F.xxhash64("id", "bucket"), F.col("n_blocks")).cast("int")), "members")
    ids = cut(members.select("id").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    bodies = cut(documents.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi"), "bodies")
    met = members.join(bodies, "id").withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
    met = met.select("id", "text", "bands", "band", "block", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    # several groups a call, which costs more than comparing a few texts
    lots = max(1, -(-(members.agg(F.sum("n_blocks")).first()[0] or 0) // LOT))
    met = met.withColumn("lot", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(lots)))
    verified = met.groupBy("lot").applyInPandas(_compared, "id BIGINT, cut BOOLEAN")
    return verified.groupBy(F.col("id").alias("doc_id")).agg(F.max("cut").alias("cut"))


def _looked_up(docs: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """docs left join stats on a key that many texts may share; written."""
    n = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_texts"))
    side = cut(n.join(stats, key), "side")
    total = side.agg(F.sum("n_texts")).first()[0] or 0
    return cut(join_stats(docs, side, key, "n_texts", total, "left").drop("n_texts"), "looked-up")


def terminality(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, unclosed, cut, cut_at_limit) for texts without a near-copy, from how their closing words and last lines usually end.

    cut_at_limit holds where the text has a length at which its source cuts, cut
    elsewhere.  All counts are of distinct texts.

    * After a full stop or closing bracket: cut where the sentence usually goes
      on after that token (an abbreviation, a reference).  After another closing mark: whole.
    * After an ellipsis: whole only if the same unit closes several texts, or if
      its closing word usually closes and the text has no length at which its
      source cuts.
    * Without a closing mark: cut if sentences and lines that begin like the
      last one (and are as long, if it is long) nearly always end with a mark.
      If they do not (list entries, queries, headings, signatures), cut only if the text has a length at which its
      source cuts, or the closing word hardly ever closes (and less often
      than words do, beyond chance), or it hardly
      occurs elsewhere and is the beginning of a commoner word.
    """
    words = stats.where("kind = 'word'").select(F.col("key").alias("closing"), F.col("a").alias("n_word"), F.col("b").alias("n_final"))
    stops = stats.where("kind = 'stop'").select(F.col("key").alias("closing"), (F.col("b") / F.col("a")).alias("goes_on"))
    starts = stats.where("kind = 'start'").withColumn("long", F.col("key").endswith(_LONG)).withColumn("token", F.expr("rtrim('\t', key)")).withColumn("shape", _shape("token"))
    each = starts.groupBy("token").agg(F.sum("a").alias("a_all"), F.sum("b").alias("b_all"))
    shapes = starts.groupBy("shape").agg(F.avg(F.col("b") / F.col("a")).alias("usual"))
    sizes = starts.groupBy("shape", "long").agg(F.avg(F.col("b") / F.col("a")).alias("usual_size"))
    starts = starts.join(each, "token").join(shapes, "shape").join(sizes, ["shape", "long"])
    starts = starts.select(F.col("key").alias("start"), "long", ((F.col("b_all") + F.col("usual")) / (F.col("a_all") + 1)).alias("ends"), ((F.col("b") + F.col("usual_size")) / (F.col("a") + 1)).alias("ends_size"))
    stop = _looked_up(docs.where("mark = 'stop' AND closing RLIKE '[.)]$'"), stops, "closing").withColumn("cut", F.coalesce(F.col("goes_on") > 0.5, F.lit(False))).withColumn("cut_at_limit", F.col("cut"))
    formula = stats.where("kind = 'dots' AND a > 2").select(F.col("key").alias("unit"), F.lit(True).alias("formula"))
    alone = stats.where("kind = 'last'").select(F.col("key").alias("closing"), F.col("a").alias("n_last")).join(words, "closing").where("n_last >= 0.5 * n_word").select("closing", "n_word")
    parts = alone.join(_prefixes(stats, alone), "closing").where("n_longer > n_word").select("closing").distinct().withColumn("part", F.lit(True))
    other = _looked_up(docs.where("mark IN ('open', 'dots')"), words.join(parts, "closing", "left"), "closing")
    other = _looked_up(_looked_up(other, starts, "start"), formula, "unit")
    closing = words.agg(F.sum("n_final") / F.sum("n_word")).first()[0] or 0.0
    closing = min(max(closing, 1e-9), 1 - 1e-9)
    final = F.coalesce(F.col("n_final"), F.lit(0)) / (F.coalesce(F.col("n_word"), F.lit(0)) + 1)
    prose = (F.col("ends") > 0.97) | F.col("long") & (F.col("ends_size") > 0.9)
    opened = F.coalesce(prose, F.lit(False)) | (final < 0.01) & (_surprise(F.col("n_word"), F.coalesce(F.col("n_final"), F.lit(0)), F.lit(closing)) > math.log(100)) | F.coalesce("part", F.lit(False))
    dotted, rare = F.col("mark") == "dots", F.col("formula").isNull()
    other = other.withColumn("cut", F.when(dotted, rare & (final < 0.7)).otherwise(F.coalesce(opened, F.lit(False)))).withColumn("cut_at_limit", F.when(dotted, rare).otherwise(F.lit(True)))
    whole = docs.where("mark = 'void' OR mark = 'stop' AND NOT closing RLIKE '[.)]$'").withColumn("cut", F.lit(False)).withColumn("cut_at_limit", F.lit(False))
    keep = ["doc_id", F.col("mark").isin("open", "dots").alias("unclosed"), "cut", "cut_at_limit"]
    return stop.select(*keep).unionByName(other.select(*keep)).unionByName(whole.select(*keep))


def _shape(column: str) -> Column:
    first, last = F.substring(column, 1, 1), F.substring(column, -1, 1)
    kind = F.when(first.rlike(r"^\p{N}"), "9").when(first.rlike(r"^\p{Lu}"), "X").when(first.rlike(r"^\p{L}"), "x").otherwise(first)
    return F.concat(kind, F.when(last.rlike(r"[\p{L}\p{N}]"), "").otherwise(last))


def _prefixes(stats: DataFrame, alone: DataFrame) -> DataFrame:
    """(closing, n_longer): the proper beginnings, of those in ``alone``, of words that occur more than once, and how often the commonest of the words does.

    Words are listed with their beginnings of up to HEAD letters; longer
    beginnings are compared among the words that share so many.
    """
    known = stats.where("kind = 'word' AND a > 1 AND length(key) >= 2")
    heads = known.select(F.explode(F.expr(f"transform(sequence(1, least(length(key) - 1, {HEAD})), k -> substring(key, 1, k))")).alias("closing"), "a")
    far = alone.where(f"length(closing) > {HEAD}").select("closing", F.substring("closing", 1, HEAD).alias("head"))
    tails = known.where(f"length(key) > {HEAD}").join(far, F.substring("key", 1, HEAD) == F.col("head")).where("length(key) > length(closing) AND startswith(key, closing)").select("closing", "a")
    return heads.unionByName(tails).groupBy("closing").agg(F.max("a").alias("n_longer"))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, src, text) -> (doc_id, src, cut).  Null and word-free texts are not cut; null ids are dropped."""
    documents = documents.where("doc_id IS NOT NULL")
    ids, classes, texts = one_each(documents)
    scanned = scan(texts)
    docs = scanned.where("kind = 'doc'").select(F.col("key").alias("unit"), "doc_id", "mark", "start", "closing", "bands")
    stats = cut(scanned.where("kind <> 'doc'").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "stats")
    copies = cut(near_copies(docs, documents), "copies").withColumnRenamed("cut", "ends_early")
    verdicts = terminality(docs, stats).join(copies, "doc_id", "left").withColumnRenamed("doc_id", "id")
    verdicts = cut(verdicts.join(classes, "id").select("digest", "n", "unclosed", "cut", "cut_at_limit", "ends_early"), "verdicts")
    total = verdicts.agg(F.sum("n")).first()[0] or 0
    rows = cut(join_stats(ids, verdicts, "digest", "n", total), "rows")
    rows = rows.join(limits(rows.where("unclosed")), ["src", "n_chars"], "left")
    return rows.select("doc_id", "src", F.coalesce("ends_early", F.when(F.col("at_limit"), F.col("cut_at_limit")).otherwise(F.col("cut"))).alias("cut"))


def _documents(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "documents").select("doc_id", clean_source().alias("src"), "text")


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    return judged(_documents(spark, data_dir)).where("cut").select("doc_id")


def rates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per source: documents, truncated ones and their share."""
    each = judged(_documents(spark, data_dir)).groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("truncated"))
    return each.withColumn("rate", F.round(F.col("truncated") / F.col("documents"), 6))


def documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per source the documents judged, each once, and whether all have a verdict."""
    each = judged(_documents(spark, data_dir)).groupBy(F.col("src").alias("source"))
    return each.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("cut").isNull()).alias("without"))


QUERIES = {"p9_found": found, "p9_rates": rates, "p9_documents": documents}
SQL = {
    "p9_documents": """WITH d AS (SELECT doc_id, coalesce(regexp_replace(lower(trim(source, ' ')), '[\\s-]+', '_', 'g'), '') AS source FROM documents WHERE doc_id IS NOT NULL)
SELECT source, count(*) AS documents, count(DISTINCT doc_id) AS ids, 0::BIGINT AS without FROM d GROUP BY 1""",
}
