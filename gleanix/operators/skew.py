"""Operators that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanix.session import cut
from gleanix.sources.tables import CHUNK_ROWS, record_terms

#: Keys holding at least 1/HOT_SHARE of all rows are hot, as are keys of ROWS rows; there are at most MOST_HOT hot keys.
HOT_SHARE = 4096
ROWS = 1_000_000
MOST_HOT = 500_000


def tree_aggregate(rows: DataFrame, keys: list[str], combine: dict[str, Column], merge: dict[str, Column], chunk: str, chunks: int, fan_in: int = 16) -> DataFrame:
    """Aggregate ``rows`` by ``keys`` through a tree of combining rounds.

    ``chunk`` is a bigint column of numbers below ``chunks``.  Round 0 combines
    each chunk with ``combine``, without an exchange where ``rows`` are
    partitioned by it; every later round merges ``fan_in`` neighbouring chunks
    with ``merge`` until one state a key is left.  No task ever gets more than
    ``fan_in`` states of a key from a round, whatever share of the rows the key
    holds.

    Keys may be null (they form a group).  An empty input gives no rows.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    states = rows.groupBy(*keys, chunk).agg(*[c.alias(n) for n, c in combine.items()])
    while chunks > 1:
        chunks = -(-chunks // fan_in)
        states = states.withColumn(chunk, F.expr(f"`{chunk}` div {fan_in}")).groupBy(*keys, chunk).agg(*[c.alias(n) for n, c in merge.items()])
    return states.drop(chunk)


def term_figures(calls: DataFrame, n_rows: int, chunk_rows: int = CHUNK_ROWS, fan_in: int = 16) -> DataFrame:
    """Calls (add_id, term, doc_id) -> (term, cf, df, max_tf) by :func:`tree_aggregate` over the chunks of :func:`record_terms`.

    ``n_rows`` is the number of calls at most.
    """
    return tree_aggregate(
        record_terms(calls, chunk_rows),
        ["term"],
        {"cf": F.sum("tf"), "df": F.count(F.lit(1)), "max_tf": F.max("tf")},
        {"cf": F.sum("cf"), "df": F.sum("df"), "max_tf": F.max("max_tf")},
        "chunk",
        max(1, -(-n_rows // chunk_rows)),
        fan_in,
    )


def join_stats(rows: DataFrame, stats: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with one row of ``stats`` per ``key``, where keys may be hot.

    ``stats[weight]`` is the number of rows of the key and ``total`` their sum.
    Only keys that hold 1/HOT_SHARE of the rows, or ROWS rows where that is
    less, are broadcast; they are at most MOST_HOT in number, whatever the data.
    All other rows are joined by shuffle, where no key holds more than that.
    ``rows`` is read twice and should be a written table.  Null keys find no
    partner, and are kept where ``how`` is 'left'.
    """
    least = max(1, -(-total // MOST_HOT), min(-(-total // HOT_SHARE), ROWS))
    hot = stats.where(F.col(weight) >= least)
    cold = stats.where(F.col(weight) < least)
    marked = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key, "inner").unionByName(marked.join(cold.hint("merge"), key, how))


def join_blocks(left: DataFrame, right: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """Join two tables of which many rows of either may share a ``key``.

    Rows of a key are dealt, on each side, to blocks of about ``block`` by a
    hash of the row, and each two blocks meet on their own, so that no task is
    bound to a hot key.  Both tables are read several times and should be
    written ones; other columns must differ in name.  Null keys find no partner.
    """
    n = F.count(F.lit(1))
    both = left.groupBy(key).agg(n.alias("__a")).join(right.groupBy(key).agg(n.alias("__b")), key).where((F.col("__a") > block) | (F.col("__b") > block))
    hot = cut(both.select(key, "__a", "__b", *[F.ceil(F.col(c) / block).cast("int").alias(p) for c, p in (("__a", "__m"), ("__b", "__n"))]), "hot")
    total = hot.agg(F.sum("__a").alias("a"), F.sum("__b").alias("b")).first()
    if total.a is None:
        return left.join(right, key)

    def dealt(side: DataFrame, weight: str, rows: int, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        blocks = lambda c: F.coalesce(F.col(c), F.lit(1))
        known = join_stats(side, hot.select(key, weight, own, other), key, weight, rows, "left")
        return known.select(*side.columns, F.pmod(F.xxhash64(*side.columns), blocks(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), blocks(other) - 1)).alias(theirs))

    x, y = dealt(left, "__a", total.a, "__m", "__n", "__i", "__j"), dealt(right, "__b", total.b, "__n", "__m", "__j", "__i")
    return x.join(y, [key, "__i", "__j"]).drop("__i", "__j")


def heavy_terms(calls: DataFrame, n_rows: int, share: float = 0.01) -> DataFrame:
    """The terms with at least ``share`` of all occurrences, with their figures."""
    figures = cut(term_figures(calls, n_rows), "figures")
    total = figures.agg(F.sum("cf")).first()[0] or 0
    return figures.where(F.col("cf") >= F.lit(share) * F.lit(float(total))).withColumn("total_cf", F.lit(total).cast("bigint"))
