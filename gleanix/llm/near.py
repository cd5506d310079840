"""Problem 3: records whose sets of words overlap, with pivot distance tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanix.functions.text import once
from gleanix.llm.components import components
from gleanix.llm.texts import words
from gleanix.operators.skew import join_blocks, join_stats
from gleanix.plans.oracle import LATEST
from gleanix.session import cut, spread
from gleanix.sources.tables import table

#: Blocks into which the hashed words are dealt; the references are the unions of blocks.
BLOCKS = 64
#: A signature is used alone while so few sets are expected to share it.
EXPECTED = 1024
RARE = 1024
#: Words of a part of a set: larger sets are cut into two, four, ... parts.
PART = 32
#: Rows of a key from which on it is dealt to blocks.
HOT_KEY = 4096


def word_sets(collection: DataFrame) -> DataFrame:
    """(doc_id, form, words) of each record: a SHA-256 of its sorted words and its distinct words as sorted 64-bit hashes.

    A doc_id read several times counts once, with its latest text that is not null; if that has no word, the record has no row.
    """
    rows = spread(collection.where("doc_id IS NOT NULL AND doc_in IS NOT NULL").select("doc_id", "read_at", "doc_in")).select("doc_id", "read_at", F.unhex(F.sha2("doc_in", 256)).alias("tie"), once(words("doc_in")).alias("w"))
    rows = rows.select("doc_id", "read_at", "tie", F.unhex(F.sha2(F.concat_ws(" ", F.array_sort("w")), 256)).alias("form"), F.array_sort(F.transform(F.array_distinct("w"), lambda x: F.xxhash64(x))).alias("words"))
    return rows.groupBy("doc_id").agg(F.max(F.struct("read_at", "tie", "form", "words")).alias("r")).select("doc_id", "r.form", "r.words").where(F.size("words") > 0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(kind: int, base: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    h = base + np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for p in parts:
        h = _mix(h + p)
    return h


def pivot_table(of: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The pivot distance tables of ``n`` sets, shape (n, 2); word ``w[i]`` is one of set ``of[i]``.

    A set's fingerprint has one bit for every word there is.  The words are
    dealt to 64 blocks by their hash, and the reference fingerprints are the
    2**64 unions of blocks.  The Hamming distance of a set to a reference is the
    size of the reference, plus the set's words in the other blocks, less its
    words in the reference's; so the table of all distances is given by the
    counts of words in each block, and the maximum coordinate difference of two
    tables, over all references, is the sum of the differences of these counts
    (taken by the reference that is the union of the blocks in which the one
    set has more).  Counts are capped at two, which only makes that less, and
    written as the bits 'has one' and 'has two' of each block: then the maximum
    difference is the number of bits in which two tables differ.
    """
    block = (_mix(w ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(58)).astype(np.int64)
    counts = np.bincount(of * BLOCKS + block, minlength=n * BLOCKS).reshape(n, BLOCKS)
    return np.stack([np.packbits(counts >= k, axis=1, bitorder="little").view(np.int64)[:, 0] for k in (1, 2)], axis=1)


def level(size: np.ndarray, part: int) -> np.ndarray:
    """A set of ``size`` words is cut into 2**level parts, of ``part`` words at most on average."""
    return np.frexp(((size - 1) // part).astype(np.float64))[1].astype(np.int64)


@lru_cache(maxsize=256)
def _combinations(m: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array(list(combinations(range(m), 2)), np.int64).reshape(-1, 2)
    return pairs, np.array(list(combinations(range(m), 3)), np.int64).reshape(-1, 3)


def signatures(df: np.ndarray, w: np.ndarray, base: np.ndarray, n: int, threshold: float, rare: int = RARE, expected: int = EXPECTED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of sets of equal size, one a row of ``w``, whose words come in order of (df, hash).

    Two sets with Jaccard similarity >= threshold >= 0.6 have a common key.  Of
    the words ordered by rarity, both have the first three common words within
    their first ``size - overlap + 3``.  The key is one of those three words, if
    it is rare; else two of them, if few sets are expected to have both; else
    all three.  Only the frequencies decide, so both sets decide alike.  Sets
    that can have fewer than three common words have keys of their own.
    """
    rows, m = w.shape
    every = np.arange(rows)
    if m == 1:
        yield every, _key(6, base, w[:, 0])
    if m == 2:
        yield every, _key(4, base, w[:, 0], w[:, 1])
    if m == 3:
        for i, j in ((0, 1), (0, 2), (1, 2)):
            yield every, _key(4, base, w[:, i], w[:, j])
    if m < 3:
        return
    p = min(m, m - max(3, math.ceil(threshold * m - 1e-9)) + 3)
    pairs, triples = _combinations(p)
    step = max(1, 1_000_000 // max(1, len(triples)))
    for at in range(0, rows, step):
        f, x, b = df[at : at + step, :p].astype(np.float64), w[at : at + step, :p], base[at : at + step]
        common = f > rare
        r, i = np.nonzero(~common)
        yield at + r, _key(1, b[r], x[r, i])
        light = f[:, pairs[:, 0]] * f[:, pairs[:, 1]] <= expected * float(n)
        hot = common[:, pairs[:, 0]]  # the second word is as common as the first, or more
        r, i = np.nonzero(hot & light)
        yield at + r, _key(2, b[r], x[r, pairs[i, 0]], x[r, pairs[i, 1]])
        heavy = common[:, triples[:, 0]] & (f[:, triples[:, 0]] * f[:, triples[:, 1]] > expected * float(n))
        r, i = np.nonzero(heavy)
        yield at + r, _key(3, b[r], *(x[r, triples[i, k]] for k in range(3)))


_KEYS = "key BIGINT, id BIGINT, own BOOLEAN, size INT, part INT, one BIGINT, two BIGINT"


def _sign(n: int, threshold: float, rare: int, expected: int, part: int):
    def of_sets(ids: np.ndarray, at: np.ndarray, w: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(at)
        own, least = level(size, part), level(np.ceil(threshold * size - 1e-9).astype(np.int64), part)
        for mine, levels in ((True, own), (False, np.where(least < own, least, -1))):
            of = np.repeat(np.arange(len(ids)), size)
            some = levels[of] >= 0
            of, x, g = of[some], w[some], f[some]
            if not len(of):
                continue
            deep = levels[of].astype(np.uint64)
            group = _mix(x + deep) & ((np.uint64(1) << deep) - np.uint64(1))
            order = np.lexsort((group, of))  # keeps the order of words within a part
            of, x, g, group, deep = of[order], x[order], g[order], group[order], deep[order]
            starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (group[1:] != group[:-1])]))
            m = np.diff(np.concatenate([starts, [len(of)]]))
            tables = pivot_table(np.repeat(np.arange(len(m)), m), x, len(m))
            base = _mix(_mix(deep[starts] + np.uint64(1)) + group[starts])
            for k in np.unique(m):
                which = np.flatnonzero(m == k)
                cells = starts[which, None] + np.arange(k)
                for rows, keys in signatures(g[cells], x[cells], base[which], n, threshold, rare, expected):
                    if len(rows):
                        p = which[rows]
                        doc = of[starts[p]]
                        columns = [keys.view(np.int64), ids[doc], np.full(len(p), mine), size[doc].astype(np.int32), m[p].astype(np.int32), tables[p, 0], tables[p, 1]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _KEYS.split(", ")])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            at = b.column("w").offsets.to_numpy()
            w = b.column("w").values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            f = b.column("f").values.to_numpy(zero_copy_only=False)
            shift = b.column("f").offsets.to_numpy()[0] - at[0] if len(ids) else 0
            first = 0
            with np.errstate(over="ignore"):
                while first < len(ids):  # about 200,000 words at a time
                    last = max(first + 1, int(np.searchsorted(at, at[first] + 200_000, "right")) - 1)
                    yield from of_sets(ids[first:last], at[first : last + 1] - at[first], w[at[first] : at[last]], f[at[first] + shift : at[last] + shift])
                    first = last

    return sign


def candidates(sets: DataFrame, threshold: float = 0.6, rare: int = RARE, expected: int = EXPECTED, part: int = PART) -> DataFrame:
    """(a, b, near): the pairs of sets that meet, once for every common key, and whether their pivot tables are near enough.

    Sets of more than ``part`` words are cut, by a hash of the word, into parts
    of half that at least: the similarity of two sets is a mean of those of their
    parts, so one pair of parts reaches the threshold too, and parts meet in
    the place of sets.  Both sets must be cut alike, so a set also comes as it
    would be cut if it were as small as the smallest that can be similar to it.
    Every part has a pivot distance table of its own.
    """
    n = sets.count()
    each = sets.select("id", F.explode("words").alias("w"))
    lexicon = cut(each.groupBy("w").agg(F.count(F.lit(1)).alias("f")), "words")
    total = lexicon.agg(F.sum("f")).first()[0] or 0
    ranked = join_stats(each, lexicon, "w", "f", total).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("r"))
    keys = cut(ranked.select("id", F.col("r.w").alias("w"), F.col("r.f").alias("f")).mapInArrow(_sign(n, threshold, rare, expected, part), _KEYS), "keys")
    hot = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY).select("key"), "hot")
    x = keys.where("own").select("key", F.col("id").alias("a"), F.col("size").alias("s"), F.col("part").alias("p"), F.col("one").alias("o1"), F.col("two").alias("t1"))
    y = keys.select("key", F.col("id").alias("b"), F.col("size").alias("t"), F.col("part").alias("q"), F.col("one").alias("o2"), F.col("two").alias("t2"))
    if hot.isEmpty():
        met = x.hint("merge").join(y, "key")
    else:
        cold = x.join(hot, "key", "left_anti").hint("merge").join(y, "key")
        met = cold.unionByName(join_blocks(cut(x.join(hot, "key", "left_semi"), "hot-x"), cut(y.join(hot, "key", "left_semi"), "hot-y"), "key", HOT_KEY))
    smaller, larger = F.least("p", "q"), F.greatest("p", "q")
    met = met.where("s < t OR s = t AND a < b").where(F.col("s") >= F.lit(threshold) * F.col("t") - 1e-9).where(smaller >= F.lit(threshold) * larger - 1e-9)
    apart = F.bit_count(F.col("o1").bitwiseXOR(F.col("o2"))) + F.bit_count(F.col("t1").bitwiseXOR(F.col("t2")))
    slack = (1 - threshold) / (1 + threshold)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (apart <= F.lit(slack) * (F.col("p") + F.col("q")) + 1e-9).alias("near"))


def similar_sets(sets: DataFrame, threshold: float = 0.6, **settings) -> DataFrame:
    """(id, words) -> (a, b): the pairs of sets with Jaccard similarity >= threshold, a < b.

    ``sets`` is a written table of distinct sets of at least one word.  Pairs
    that cannot reach the threshold never meet (:func:`signatures`) or are
    discarded by the maximum coordinate difference of their pivot distance
    tables while they meet (:func:`pivot_table`); the survivors are verified
    word by word.  The settings of :func:`candidates` only decide how many
    signatures and candidates there are.  None of this loses a pair: sets of s
    and t words that reach the threshold differ in at most (1 - threshold) /
    (1 + threshold) * (s + t) words, and no coordinate of two tables differs by
    more than the sets do.
    """
    if threshold < 0.6:
        raise ValueError("signatures need a threshold of at least 0.6")
    pairs = candidates(sets, threshold, **settings).where("near").select("a", "b").distinct()
    side = lambda c, i: sets.select(F.col("id").alias(c), F.col("words").alias(f"w{i}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
    sizes, shared = F.size("w1") + F.size("w2"), F.size(F.array_intersect("w1", "w2"))
    return both.where(shared / (sizes - shared) >= threshold).select("a", "b")


def classes(collection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, sets): (doc_id, bag, set) and (id, words).

    ``bag`` is the smallest record with the same words equally often, ``set``
    the smallest with the same distinct words.  Copies are told apart from here
    on only by number, so a text that a third of all records share is one set.
    """
    docs = cut(word_sets(collection), "docs")
    bags = cut(docs.groupBy("form").agg(F.min("doc_id").alias("bag"), F.first("words").alias("words"), F.count(F.lit(1)).alias("copies")), "bags")
    sets = cut(bags.groupBy("words").agg(F.min("bag").alias("id")).select("id", "words"), "sets")
    named = cut(bags.join(sets, "words").select("form", "bag", F.col("id").alias("set"), "copies"), "named")
    total = docs.count()
    members = cut(join_stats(docs.select("doc_id", "form"), named, "form", "copies", total).select("doc_id", "bag", "set"), "members")
    return members, sets


def bag_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(x, y): linked bags of different words, x < y, from linked sets and from bags with the same set."""
    bags = cut(members.select("bag", "set").distinct(), "bag-sets")
    left, right = bags.select(F.col("set").alias("a"), F.col("bag").alias("x")), bags.select(F.col("set").alias("b"), F.col("bag").alias("y"))
    across = join_blocks(cut(join_blocks(links, left, "a"), "half"), right, "b").select("x", "y")
    within = join_blocks(left, right.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    return across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionByName(within)


def _found(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    members, sets = classes(table(spark, data_dir, "collection_tsv"))
    links = cut(similar_sets(sets), "links")
    return members, cut(bag_links(members, links), "bag-links")


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every linked pair of records, copies of one text included; records are joined in blocks, so many copies are not one task's."""
    members, links = _found(spark, data_dir)
    x, y = members.select(F.col("bag").alias("x"), F.col("doc_id").alias("i")), members.select(F.col("bag").alias("y"), F.col("doc_id").alias("j"))
    return join_blocks(cut(join_blocks(links, x, "x"), "half"), y, "y").select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b"))


def groups(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, group_id, n_links): every record, the smallest record it is linked to over any number of links (or copies), and the number of records it is directly linked to."""
    members, links = _found(spark, data_dir)
    named = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    copies = cut(members.groupBy("bag").agg(F.count(F.lit(1)).alias("copies")), "copies")
    ends = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    n_links = ends.join(copies.select(F.col("bag").alias("y"), "copies"), "y").groupBy("x").agg(F.sum("copies").alias("n_links"))
    per_bag = cut(copies.join(named.withColumnRenamed("node", "bag"), "bag", "left").join(n_links.withColumnRenamed("x", "bag"), "bag", "left").select("bag", "copies", F.coalesce("component", "bag").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")), "per-bag")
    total = members.count()
    return join_stats(members, per_bag, "bag", "copies", total).select("doc_id", "group_id", "n_links")


_SETS = f"""WITH RECURSIVE r AS (SELECT doc_id, arg_max(doc_in, {LATEST}) AS doc_in FROM collection_tsv WHERE doc_in IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, list_sort(regexp_extract_all(lower(doc_in), '[\\p{{L}}\\p{{N}}]+')) AS ws FROM r),
f AS (SELECT doc_id, array_to_string(ws, ' ') AS form, list_sort(list_distinct(ws)) AS s, len(list_distinct(ws)) AS n FROM w WHERE len(ws) > 0),
e AS (SELECT doc_id, n, unnest(s) AS t FROM f), o AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
near AS (SELECT o.a, o.b, x.form <> y.form AS other FROM o JOIN f x ON x.doc_id = o.a JOIN f y ON y.doc_id = o.b WHERE c / (o.n + o.m - c)::DOUBLE >= 0.6::DOUBLE)"""

QUERIES = {"p3_found": found, "p3_groups": groups}
SQL = {
    "p3_found": f"{_SETS} SELECT a AS doc_id_a, b AS doc_id_b FROM near WHERE other",
    "p3_groups": f"""{_SETS}, ends AS (SELECT a, b, other FROM near UNION ALL SELECT b, a, other FROM near),
reach AS (SELECT doc_id, doc_id AS r FROM f UNION SELECT ends.b, reach.r FROM reach JOIN ends ON ends.a = reach.doc_id),
links AS (SELECT a AS doc_id, count(*) FILTER (other) AS n_links FROM ends GROUP BY 1)
SELECT reach.doc_id, min(r) AS group_id, coalesce(any_value(n_links), 0) AS n_links FROM reach LEFT JOIN links ON links.doc_id = reach.doc_id GROUP BY 1""",
}
