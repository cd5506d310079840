"""Problem 6: texts garbled by a wrong character encoding."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gleanix.session import cut
from gleanix.sources.tables import latest_records, table

#: The wrong encodings: UTF-8 bytes were read as one of these.
CODECS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8_r"]
LOST = "lost"
ENTITY = "entity"
CLEAN = "clean"
_ENTITIES = re.compile(r"&(?:#\d{2,7}|#x[0-9a-fA-F]{2,6}|[A-Za-z]{2,8}\d{0,2});")
_BACKOFF = 0.02
_FLOOR = 1e-4
#: Log of how often a sound character beyond ASCII follows another.
_ADJACENT = math.log(0.1)


@lru_cache(maxsize=None)
def _reader(codec: str) -> tuple[re.Pattern, dict[str, int]]:
    """A pattern of what UTF-8 sequences look like when read with ``codec``, and the byte of each character."""
    byte = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)  # lenient decoders pass such bytes through
        byte.setdefault(c, b)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in byte.items() if lo <= b <= hi) + "]"
    more = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xC2, 0xDF)}{more}|{cls(0xE0, 0xEF)}{more}{{2}}|{cls(0xF0, 0xF4)}{more}{{3}}"), byte


#: What is left of "à" where a no-break space within a sequence became a plain one: the blank before another, a mark or the end.
_BLANK_A = re.compile(r"(?<![A-ZÀ-Þ]{2})Ã (?=[\s.,;:!?)»]|$)")


def _spans(text: str, codec: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, restored) of every sequence that is valid UTF-8 under ``codec``."""
    pattern, byte = _reader(codec)
    for m in pattern.finditer(text):
        try:
            yield m.start(), m.end(), bytes(byte[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            pass
    if codec in ("cp1252", "latin-1"):
        for m in _BLANK_A.finditer(text):
            yield m.start(), m.end(), "à"


def undo(text: str, codec: str, seen: Counter | None = None) -> str:
    """Read every sequence that is valid UTF-8 under ``codec`` as UTF-8; ``seen`` counts (garbled, restored)."""
    out, at = [], 0
    for start, end, u in sorted(_spans(text, codec)):
        if seen is not None:
            seen[text[start:end], u] += 1
        out += [text[at:start], u]
        at = end
    return "".join([*out, text[at:]])


def _read_entities(text: str) -> tuple[str, list[str]]:
    """The text with entities of characters beyond ASCII read, and what each of its characters was written as."""
    chars, written, at = [], [], 0
    for m in _ENTITIES.finditer(text):
        c = html.unescape(m[0])
        if len(c) == 1 and not c.isascii():
            plain = text[at : m.start()]
            chars += [plain, c]
            written += [*plain, m[0]]
            at = m.end()
    return "".join([*chars, text[at:]]), [*written, *text[at:]]


def repair(text: str, chain: str) -> str | None:
    """Undo a chain; null for text whose characters were lost.  Entities that belong to no garbled sequence stay as they are written."""
    if chain == LOST:
        return None
    steps = chain.split(">")
    read, written = _read_entities(text) if steps[0] == ENTITY else (text, list(text))
    for step in steps[steps[0] == ENTITY :]:
        chars, as_written, at = [], [], 0
        for start, end, u in sorted(_spans(read, step)):
            chars += [read[at:start], u]
            as_written += [*written[at:start], u, *[""] * (len(u) - 1)]
            at = end
        read, written = "".join([*chars, read[at:]]), [*as_written, *written[at:]]
    return "".join(written)


def evidence(text: str) -> Iterator[tuple[str, Counter]]:
    """(chain, counts of (garbled, restored)) for every chain of one or two wrong readings of which the text has a trace.

    The text as it is comes first; with its entities read it is a reading of its
    own where that adds a trace.
    """
    if "�" in text:
        yield LOST, Counter({("�", ""): text.count("�")})
    starts = [("", text)]
    if "&" in text and (plain := _read_entities(text)[0]) != text:
        starts.append((ENTITY + ">", plain))
    traces: dict[str, int] = {}
    for name, start in starts:
        for codec in CODECS:
            seen: Counter = Counter()
            once = undo(start, codec, seen)
            traces[name + codec] = seen.total()
            if not seen or name and traces[name + codec] <= traces[codec]:
                continue
            yield name + codec, seen
            parts = {u for _, u in seen}
            for second in CODECS:
                deeper: Counter = Counter()
                undo(once, second, deeper)
                whole: Counter = Counter()
                for (g, u), n in deeper.items():
                    # a second reading counts only where the first restored all it is made of
                    if all(c in parts for c in g) and (k := min(n, start.count(twice := "".join(_garble(c, codec) for c in g)))):
                        whole[twice, u] += k
                if whole:
                    yield f"{name}{codec}>{second}", whole


@lru_cache(maxsize=65536)
def _garble(c: str, codec: str) -> str:
    """What ``codec`` makes of the character's UTF-8 bytes."""
    back = {b: x for x, b in _reader(codec)[1].items()}
    return "".join(back[b] for b in c.encode("utf-8"))


_EVIDENCE = "doc_id BIGINT, feed STRING, chains ARRAY<STRING>, at ARRAY<INT>, garbled ARRAY<STRING>, restored ARRAY<STRING>, n ARRAY<INT>"


def signs(records: DataFrame) -> DataFrame:
    """(doc_id, feed, doc_in) -> one row per record with a trace of a chain: the chains, and its sequences, each with the place of its chain in ``at``.

    Only texts with a character beyond ASCII or an entity leave the JVM.
    """

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, f, t in zip(p.doc_id, p.feed, p.doc_in):
                if traces := list(evidence(t)):
                    seen = [(at, g, u, k) for at, (_, counts) in enumerate(traces) for (g, u), k in counts.items()]
                    rows.append((i, f, [chain for chain, _ in traces], *map(list, zip(*seen))))
            yield pd.DataFrame(rows, columns=["doc_id", "feed", "chains", "at", "garbled", "restored", "n"])

    return records.where(F.col("doc_in").rlike(r"[^\x00-\x7F]|&#?\w+;")).mapInPandas(scan, _EVIDENCE)


def character_counts(records: DataFrame) -> Counter:
    """How often each character beyond ASCII occurs.  The alphabet bounds what the driver gets.

    U+FFFD is left out: it stands for a lost character, whoever wrote it down.
    """
    odd = records.select(F.regexp_replace("doc_in", r"[\x00-\x7F\x{FFFD}]+", "").alias("t")).where("t <> ''")
    rows = odd.select(F.explode(F.split("t", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    return Counter({r.c: r["count"] for r in rows})


def _usual(c: str) -> float:
    """Counts added to letters and marks that Western texts use, seen before or not."""
    return 1.0 if 0xA0 <= ord(c) <= 0xFF or 0x2010 <= ord(c) <= 0x203A or c in "€™" else 0.02 if 0x100 <= ord(c) <= 0x17F else 0.0


def _score(chars: Counter):
    """A function that gives the log of how much likelier a sequence is as the restored character than as sound text.

    A character's probability is its share of the characters beyond ASCII,
    backed off to its block of 128 code points.  In sound text few of them
    stand side by side, but letters of one block do: words keep to one script.
    """
    blocks: Counter = Counter()
    for c, n in chars.items():
        blocks[ord(c) >> 7] += max(0.0, n)
    log_total = math.log(sum(blocks.values()) + 1)
    counts = {c: max(0.0, n) for c, n in chars.items()}

    def p(c: str) -> float:
        return math.log(counts.get(c, 0.0) + _BACKOFF * blocks[ord(c) >> 7] / 128 + max(_usual(c), _FLOOR)) - log_total

    def original(u: str, width: int) -> float:
        """A character without any support is less likely than any ``width`` characters that do occur."""
        supported = _usual(u) or counts.get(u, 0.0) + _BACKOFF * blocks[ord(u) >> 7] / 128 > 0.01
        return p(u) if supported else math.log(_FLOOR) - width * (log_total - _ADJACENT)

    def sound(g: str) -> float:
        logs, before = 0.0, ""
        for c in g:
            if c.isascii():
                before = ""
                continue
            logs += p(c)
            if before.isalpha() and c.isalpha() and ord(before) >> 7 == ord(c) >> 7:
                logs += log_total - math.log(2 * blocks[ord(c) >> 7] + 1)
            elif before:
                logs += _ADJACENT
            before = c
        return logs

    def score(garbled: str, restored: str) -> float:
        return (original(restored, len(garbled)) if restored else 0.0) - sound(garbled)

    return score


def posteriors(records: DataFrame, most_rounds: int = 25, settled: float = 1e-3, pull: float = 20.0) -> DataFrame:
    """(doc_id, feed, doc_in) -> (doc_id, chain, posterior) for records with a trace of a chain.

    Expectation-maximisation with a latent chain for every record.  A sequence
    of characters is either sound, or one character of the original text seen
    through the chain; which of the two is likelier depends on how common the
    characters are in sound text.  The weights of the chains are kept for each
    feed (drawn to those of all feeds by ``pull`` records) and the commonness of
    characters for the whole collection; both are estimated again in each
    round, so that weak traces weigh more in a feed with many strong ones.
    Rounds end when the weights of all feeds and chains have moved by no more
    than ``settled`` of their sum, or after ``most_rounds``.
    ``doc_id`` must be unique.  Null texts have no trace.

    A record is one row with all its chains, so that a round is one join, by
    feed, and few exchanges: the driver keeps a thread for each exchange and
    broadcast for a minute, and the plans of all rounds for as long as it lives.
    """
    records = records.where("doc_in IS NOT NULL").withColumn("feed", F.coalesce("feed", F.lit("")))
    found = cut(signs(records), "signs")
    base = character_counts(records)
    feeds = cut(records.groupBy("feed").agg(F.count(F.lit(1)).cast("double").alias("n_feed")), "feeds")
    n_all = feeds.agg(F.sum("n_feed")).first()[0] or 0
    chars = base
    weights = found.select("feed", F.explode("chains").alias("chain")).groupBy("feed", "chain").agg(F.count(F.lit(1)).cast("double").alias("now"))
    weights = cut(weights.join(feeds, "feed").withColumn("w", F.lit(0.0)), "weights")
    totals = _totals(weights)
    for _ in range(most_rounds):
        share = {r.chain: r.now / max(1, n_all) for r in totals}
        post = cut(_expect(found, weights, share, pull, _score(chars)), "posterior")
        each = post.select("feed", "n_feed", F.explode(F.arrays_zip("chains", "posteriors", "w")).alias("s"))
        weights = cut(each.groupBy("feed", F.col("s.chains").alias("chain")).agg(F.sum("s.posteriors").alias("now"), F.max("s.w").alias("w"), F.max("n_feed").alias("n_feed")), "weights")
        totals = _totals(weights)
        if sum(r.by for r in totals) <= settled * sum(r.now for r in totals):
            break
        chars = _maximise(base, post)
    return post.select("doc_id", F.explode(F.arrays_zip("chains", "posteriors")).alias("s")).select("doc_id", F.col("s.chains").alias("chain"), F.col("s.posteriors").alias("posterior"))


def _totals(weights: DataFrame) -> list[Row]:
    """(chain, now, by): each chain's weight over all feeds, and by how much it moved.  There are no more rows than chains."""
    return weights.groupBy("chain").agg(F.sum("now").alias("now"), F.sum(F.abs(F.col("now") - F.col("w"))).alias("by")).collect()


def _expect(found: DataFrame, weights: DataFrame, share: dict[str, float], pull: float, score) -> DataFrame:
    """The records with the posteriors of their chains, the weights these started from and the size of the feed."""

    @F.pandas_udf("array<double>")
    def posterior(chains: pd.Series, at: pd.Series, garbled: pd.Series, restored: pd.Series, n: pd.Series, w: pd.Series, w_feed: pd.Series, n_feed: pd.Series) -> pd.Series:
        out = []
        for names, places, gs, us, ks, ws, in_feed, size in zip(chains, at, garbled, restored, n, w, w_feed, n_feed):
            clean = math.log(max(size - in_feed, 0.5) / size)
            xs = [math.log(max((v + pull * share[c]) / (size + pull), 1e-12)) - clean for c, v in zip(names, ws)]
            for place, g, u, k in zip(places, gs, us, ks):
                xs[place] += k * score(g, u)
            top = max(0.0, *xs)
            norm = top + math.log(math.exp(-top) + sum(math.exp(x - top) for x in xs))
            out.append([math.exp(x - norm) for x in xs])
        return pd.Series(out, dtype=object)

    of_feed = weights.groupBy("feed").agg(F.map_from_entries(F.collect_list(F.struct("chain", "now"))).alias("of"), F.sum("now").alias("w_feed"), F.max("n_feed").alias("n_feed"))
    known = found.join(of_feed, "feed").withColumn("w", F.transform("chains", lambda c: F.element_at("of", c))).drop("of")
    return known.withColumn("posteriors", posterior("chains", "at", "garbled", "restored", "n", "w", "w_feed", "n_feed")).drop("w_feed")


def _maximise(base: Counter, post: DataFrame) -> Counter:
    seq = post.select("posteriors", F.explode(F.arrays_zip("at", "garbled", "restored", "n")).alias("s"))
    seq = seq.select((F.get("posteriors", F.col("s.at")) * F.col("s.n")).alias("w"), "s.garbled", "s.restored")
    of = lambda text, w: F.transform(F.split(text, ""), lambda c: F.struct(c.alias("c"), w.alias("w")))
    moved = seq.select(F.explode(F.concat(of("garbled", -F.col("w")), of("restored", F.col("w")))).alias("s")).select("s.c", "s.w")
    chars = Counter(base)
    for r in moved.where("c <> ''").groupBy("c").agg(F.sum("w").alias("w")).collect():
        if r.w <= 0 or base[r.c] > 0 or _usual(r.c) == 1.0:  # traces alone don't make a character one of the language's
            chars[r.c] = max(0.0, chars[r.c] + r.w)
    return chars


def _records(spark: SparkSession, data_dir: str) -> DataFrame:
    """One text a doc_id: the latest that is not null."""
    return latest_records(table(spark, data_dir, "collection_tsv").where("doc_in IS NOT NULL"), "feed", "doc_in")


def best_chain(post: DataFrame) -> DataFrame:
    """(doc_id, chain, p_clean) of the records that are garbled more likely than not."""
    best = post.groupBy("doc_id").agg(F.max_by("chain", F.struct("posterior", "chain")).alias("chain"), (1 - F.sum("posterior")).alias("p_clean"))
    return best.where("p_clean < 0.5")


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    return best_chain(posteriors(cut(_records(spark, data_dir), "records"))).select("doc_id")


def restored(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, chain, p_clean, doc_in) of the garbled records; doc_in is null where characters were lost."""
    records = cut(_records(spark, data_dir), "records")

    @F.pandas_udf("string")
    def undo_chain(text: pd.Series, chain: pd.Series) -> pd.Series:
        return pd.Series([repair(t, c) for t, c in zip(text, chain)], dtype=object)

    return records.join(best_chain(posteriors(records)), "doc_id").select("doc_id", "chain", F.round("p_clean", 6).alias("p_clean"), undo_chain("doc_in", "chain").alias("doc_in"))


QUERIES = {"p6_found": found, "p6_restored": restored}
SQL: dict[str, str] = {}
