"""Problem 8: a mixture of sources with target shares."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanix.llm.packing import clean_source
from gleanix.llm.tokens import with_tokens
from gleanix.session import cut, spread
from gleanix.sources.tables import table

#: Parts of a (source, length) group by seeded hash; only one part of a group is ever ranked.
PARTS = 1024
TARGET = ["source", "target_share", "max_repeats"]
#: The remaining budget, in tokens, that is left to dynamic programming.
EXACT = 65_536


def exact_sum(budget: int, available: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that the sum comes as near to the budget from below as it can.

    Bounded knapsack by dynamic programming: bit v of a number says whether the
    sum v can be reached; each length is added in powers of two of its count.
    """
    reach, steps = 1, []
    everything = (1 << (budget + 1)) - 1
    for length in sorted(available):
        left = min(available[length], budget // length) if 0 < length <= budget else 0
        k = 1
        while left > 0 and not reach >> budget & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & everything
            left -= k
            k *= 2
        if reach >> budget & 1:
            break
    v = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> v & 1:
            v -= length * k
            taken[length] = taken.get(length, 0) + k
    return taken


def fit(lengths: list[int], counts: list[int], budget: int, seed: int = 0) -> list[int]:
    """How many documents of each length to take for ``budget`` tokens in all, never more than the budget.

    First the same share of every length; then single documents of lengths in
    seeded order until little is left; the rest by :func:`exact_sum`.
    """
    supply = sum(n * c for n, c in zip(lengths, counts))
    if budget >= supply:
        return list(counts)
    if budget <= 0:
        return [0] * len(lengths)
    taken = [c * budget // supply for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken))
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    moved = True
    while left > EXACT and moved:
        moved = False
        for i in order:
            if left <= EXACT:
                break
            if taken[i] < counts[i] and lengths[i] <= left:
                taken[i] += 1
                left -= lengths[i]
                moved = True
    left = min(left, max(EXACT, 0)) if left <= EXACT else EXACT
    at = {n: i for i, n in enumerate(lengths)}
    for n, k in exact_sum(left, {n: c - t for n, c, t in zip(lengths, counts, taken)}).items():
        taken[at[n]] += k
    return taken


def plan(histogram: DataFrame, targets: DataFrame, total_tokens: int, seed: int = 0) -> DataFrame:
    """(src, tokens, n) and (source, target_share, max_repeats) -> (src, tokens, rounds, more).

    Of each length of a source, ``more`` documents are used ``rounds + 1`` times
    and the others ``rounds`` times.  A source's budget is its share of
    ``total_tokens``; whole rounds are taken first, the rest is fitted exactly.
    Runs on the histogram, one task a source, whose rows are distinct lengths.
    """

    def of_source(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("tokens")
        lengths, counts = p.tokens.astype(int).tolist(), p.n.astype(int).tolist()
        supply = sum(n * c for n, c in zip(lengths, counts))
        budget = int(float(p.target_share.iloc[0]) * total_tokens)
        most = max(0, int(p.max_repeats.iloc[0]))
        rounds = min(most, budget // supply) if supply else 0
        more = fit(lengths, counts, budget - rounds * supply, seed) if rounds < most else [0] * len(lengths)
        return pd.DataFrame({"src": p.src, "tokens": p.tokens, "rounds": rounds, "more": more})

    return histogram.select("src", "tokens", "n").join(targets.select(*TARGET).where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0"), F.col("src") == F.col("source")).groupBy("src").applyInPandas(of_source, "src STRING, tokens INT, rounds INT, more BIGINT")


def feasible_total(supplies: list[tuple[float, int, int]]) -> int:
    """The largest total at which every source that has documents can give its share: (share, max_repeats, tokens)."""
    return int(min((tokens * repeats / share for share, repeats, tokens in supplies if tokens > 0 and share > 0 and repeats > 0), default=0))


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int = 11) -> DataFrame:
    """(doc_id, src, tokens) -> (doc_id, src, tokens, uses), uses >= 1.

    Sources that cannot give their share of ``total_tokens`` give all documents
    ``max_repeats`` times.  For None the total is the largest at which every
    source that has documents can give its share.
    Documents of no tokens, of no source or of a source without a target are
    not used.  Which documents of a length are used is decided by a seeded hash
    of their ids.  ``sized`` is a written table.
    """
    rows = sized.where("doc_id IS NOT NULL AND tokens > 0").select("doc_id", "src", "tokens", F.xxhash64("doc_id", F.lit(seed)).alias("turn")).withColumn("part", F.pmod("turn", F.lit(PARTS)).cast("int"))
    parts = cut(rows.groupBy("src", "tokens", "part").agg(F.count(F.lit(1)).alias("n_part")), "parts")
    histogram = cut(parts.groupBy("src", "tokens").agg(F.sum("n_part").alias("n")), "histogram")
    if total_tokens is None:
        total_tokens = feasible_total([(r.target_share, r.max_repeats, int(r.tokens)) for r in supplies(histogram, targets).collect()])  # one row for each target
    planned = plan(histogram, targets, total_tokens, seed)
    before = Window.partitionBy("src", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = parts.join(planned, ["src", "tokens"]).withColumn("before", F.coalesce(F.sum("n_part").over(before), F.lit(0))).select("src", "tokens", "part", "rounds", F.greatest(F.lit(0), F.least(F.col("n_part"), F.col("more") - F.col("before"))).alias("take")).where("rounds > 0 OR take > 0")
    ranked = rows.join(quota.hint("merge"), ["src", "tokens", "part"]).withColumn("rank", F.row_number().over(Window.partitionBy("src", "tokens", "part").orderBy("turn", "doc_id")))
    return ranked.select("doc_id", "src", "tokens", (F.col("rounds") + F.when(F.col("rank") <= F.col("take"), 1).otherwise(0)).alias("uses")).where("uses > 0")


def supplies(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: (source, target_share, max_repeats, documents, tokens) with zeros where it has no documents."""
    per = histogram.groupBy("src").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"))
    return targets.select(*TARGET).join(per, F.col("source") == F.col("src"), "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def report(mixture: DataFrame, sized: DataFrame, targets: DataFrame, label: str) -> DataFrame:
    """Per target: what the source has, what was used, and the share it really reached."""
    used = mixture.groupBy("src").agg(F.sum(F.col("tokens").cast("bigint") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("used_documents"))
    has = sized.where("tokens > 0").groupBy("src", "tokens").agg(F.count(F.lit(1)).alias("n"))
    rows = supplies(has, targets).join(used, F.col("source") == F.col("src"), "left").drop("src")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = rows.select(F.lit(label).alias("total"), "source", "target_share", "max_repeats", "documents", F.col("tokens").alias("has_tokens"), zero("used_documents"), zero("most_uses"), zero("used_tokens"))
    whole = F.sum("used_tokens").over(Window.partitionBy("total"))  # one row for each target
    return rows.withColumn("actual_share", F.round(F.col("used_tokens") / F.nullif(whole, F.lit(0).cast("bigint")), 6))


def _inputs(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(with_tokens(spread(table(spark, data_dir, "documents").select("doc_id", clean_source().alias("src"), "text"))), "sized")
    return sized, table(spark, data_dir, "mix_targets")


def _size(sized: DataFrame) -> int:
    return sized.agg(F.sum("tokens").alias("t")).first().t or 0


def mixture(spark: SparkSession, data_dir: str) -> DataFrame:
    """A mixture of as many tokens as the collection has."""
    sized, targets = _inputs(spark, data_dir)
    return mix(sized, targets, _size(sized))


def shares(spark: SparkSession, data_dir: str) -> DataFrame:
    """The report for the largest total that every source can serve, and for a total of the size of the collection, which some cannot."""
    sized, targets = _inputs(spark, data_dir)
    whole = _size(sized)
    return report(cut(mix(sized, targets, None), "mix"), sized, targets, "feasible").unionByName(report(cut(mix(sized, targets, whole), "mix"), sized, targets, "collection"))


def kept(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per target: the source's documents of any size, and whether the report's figures fit together: no use beyond max_repeats, no budget exceeded, all documents used as often as allowed where that does not fill it."""
    sized, targets = _inputs(spark, data_dir)
    total = _size(sized)
    rows = report(cut(mix(sized, targets, total), "mix"), sized, targets, "collection")
    budget = F.floor(F.col("target_share") * total)
    most = F.col("has_tokens") * F.col("max_repeats")
    whole = F.when(most <= budget, F.col("used_tokens") == most).otherwise(F.col("used_tokens") <= budget)
    return rows.select("source", "documents", (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"), whole.alias("share_kept"))


QUERIES = {"p8_mixture": mixture, "p8_shares": shares, "p8_kept": kept}
SQL = {
    "p8_kept": """WITH d AS (SELECT coalesce(regexp_replace(lower(trim(source, ' ')), '[\\s-]+', '_', 'g'), '') AS src FROM documents WHERE text <> '')
SELECT source, count(src) AS documents, true AS repeats_kept, true AS share_kept FROM mix_targets LEFT JOIN d ON src = source GROUP BY source""",
}
