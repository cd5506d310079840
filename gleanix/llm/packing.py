"""Problem 7: documents into containers of fixed capacity."""

from __future__ import annotations

import math
from collections import deque
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanix.llm.tokens import with_tokens
from gleanix.session import cut, spread
from gleanix.sources.tables import table

#: Tokens of a shard, the part of the collection that one task packs.
SHARD_TOKENS = 2_000_000
#: Containers of a window, the unit for which the mixture is kept, and the tokens that bound it where containers are large.
WINDOW, LEAST_WINDOW, WINDOW_TOKENS = 64, 8, 65_536
#: Waiting pieces of a source among which one is sought that fills a gap.
AHEAD = 48


def clean_source(source: str = "source") -> Column:
    """The source's name without stray case, blanks and hyphens; the empty string for null."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(F.col(source))), r"[\s-]+", "_"), F.lit(""))


class Containers:
    """At most ``most`` open containers by the room left; an item goes where it leaves least."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count = capacity, most, 0
        self._by_room: dict[int, list[int]] = {}
        self._rooms = 0  # bit r: some container has room r

    def room(self) -> int:
        """The size of the largest item that can still be put."""
        return self.capacity if self.count < self.most else self._rooms.bit_length() - 1

    def put(self, size: int) -> int | None:
        """The container that takes the item; None if there is none."""
        fits = self._rooms >> size
        if size > 0 and fits:
            room = size + (fits & -fits).bit_length() - 1
            same = self._by_room[room]
            at = same.pop()
            if not same:
                self._rooms ^= 1 << room
        else:
            if size == 0 and self.count:
                return self.count - 1
            if self.count == self.most:
                return None
            at, room = self.count, self.capacity
            self.count += 1
        if room > size:
            left = room - size
            self._by_room.setdefault(left, []).append(at)
            self._rooms |= 1 << left
        return at


def window_size(capacity: int) -> int:
    """Containers of a window."""
    return max(LEAST_WINDOW, min(WINDOW, WINDOW_TOKENS // capacity))


def fill_windows(queues: dict[str, deque], weights: dict[str, float], deficits: dict[str, float], capacity: int, aimed: set[str]):
    """Deficit round-robin into closed windows: yields (mixed, aims, [(container, source, piece), ...]) and empties the queues.

    A queue holds pieces, tuples that begin with their size.  A window is a fixed
    number of containers and shares none with another.  Each window gives every
    waiting source its share of the window's tokens on top of the deficit that
    it carries; a source is served while its deficit covers its next piece.  The
    pieces go into the containers best fit, largest first; what does not fit
    goes back to the head of its queue and is owed.  Gaps are filled by later
    pieces of the sources, the one that is owed most first, as long as a source
    is not ahead by more than half a container.  The share of an exhausted
    source goes to the others: a window is ``mixed`` while all ``aimed`` sources wait.
    """
    most = window_size(capacity)
    waiting = {s for s, q in queues.items() if q}
    while waiting:
        whole = sum(weights[s] for s in waiting)
        aims = {s: weights[s] / whole if whole > 0 else 1 / len(waiting) for s in waiting}
        taken = []
        for s in sorted(waiting):
            deficits[s] += aims[s] * most * capacity
            q = queues[s]
            while q and q[0][0] <= deficits[s]:
                deficits[s] -= q[0][0]
                taken.append((s, q.popleft()))
        box, placed, back = Containers(capacity, most), [], {}
        for s, piece in sorted(taken, key=lambda x: (-x[1][0], x[1][1:], x[0])):
            at = box.put(piece[0])
            if at is None:
                back.setdefault(s, set()).add(piece)
            else:
                placed.append((at, s, piece))
        for s in back:
            queues[s].extendleft(reversed([p for t, p in taken if t == s and p in back[s]]))
            deficits[s] += sum(p[0] for p in back[s])
        tried: set[str] = set()
        while room := box.room():
            s = max((s for s in waiting if queues[s] and s not in tried and deficits[s] > -capacity / 2), key=lambda s: (deficits[s], s), default=None)
            if s is None:
                break
            q = queues[s]
            fits = max(((p[0], -i) for i, p in enumerate(islice(q, AHEAD)) if 0 < p[0] <= room and p[0] <= deficits[s] + capacity / 2), default=None)
            if fits is None:
                tried.add(s)
                continue
            piece = q[-fits[1]]
            del q[-fits[1]]
            deficits[s] -= piece[0]
            placed.append((box.put(piece[0]), s, piece))
        waiting = {s for s in waiting if queues[s]}
        if placed:
            yield aimed <= waiting, aims, placed


def pack_shard(p: pd.DataFrame) -> pd.DataFrame:
    """One shard for one capacity.  Columns: limit_no, capacity, shard, turn, doc_id, src, tokens, weight, aimed, deficit."""
    limit_no, capacity, shard = int(p.limit_no.iloc[0]), int(p.capacity.iloc[0]), int(p.shard.iloc[0])
    p = p.sort_values(["turn", "doc_id"], kind="stable")
    queues: dict[str, deque] = {}
    weights, deficits, aimed = {}, {}, set()
    for s, doc, tokens, w, a, d in zip(p.src, p.doc_id.tolist(), p.tokens.tolist(), p.weight.tolist(), p.aimed.tolist(), p.deficit.tolist()):
        if s not in queues:
            queues[s], weights[s], deficits[s] = deque(), w, d
            aimed |= {s} if a else set()
        full, rest = divmod(tokens, capacity)
        queues[s].extend((capacity, doc, k) for k in range(full))
        if rest or not full:
            queues[s].append((rest, doc, full))
    out: list[list] = [[] for _ in range(8)]
    before = 0
    for w, (mixed, aims, placed) in enumerate(fill_windows(queues, weights, deficits, capacity, aimed)):
        for at, s, (size, doc, k) in placed:
            for column, v in zip(out, (w, mixed, s, aims[s], before + at, doc, k, size)):
                column.append(v)
        before += max(at for at, _, _ in placed) + 1
    n = len(out[0])
    return pd.DataFrame({"limit_no": np.full(n, limit_no, np.int32), "capacity_tokens": np.full(n, capacity, np.int32), "shard": np.full(n, shard, np.int32), "window_no": np.array(out[0], np.int32), "mixed": np.array(out[1], bool), "src": out[2], "aim": np.array(out[3], np.float64), "container_no": np.array(out[4], np.int64), "doc_id": np.array(out[5], np.int64), "piece_no": np.array(out[6], np.int32), "tokens": np.array(out[7], np.int32)})


_PACKED = "limit_no INT, capacity_tokens INT, shard INT, window_no INT, mixed BOOLEAN, src STRING, aim DOUBLE, container_no BIGINT, doc_id BIGINT, piece_no INT, tokens INT"


def pack(sized: DataFrame, limits: list[tuple[int, int]], shares: dict[str, float], shard_tokens: int = SHARD_TOKENS, seed: int = 7) -> DataFrame:
    """(doc_id, src, tokens) -> every piece of every document, once for each (limit_no, capacity).

    Documents are spread over shards of about ``shard_tokens`` by a seeded hash,
    so every shard has every source's share of the whole and no source or
    publisher makes one shard larger.  In a shard, deficit round-robin over the
    sources fills one closed window of containers after another to the target
    shares (:func:`fill_windows`).  A window is ``mixed`` while every source
    that has a target, and documents in the shard, still has some waiting; what
    follows is the rest, in which the sources left keep their proportions.
    ``aim`` is the share of its window that a piece's source was to have.
    A shard starts with the deficits that the shards before it left: what the
    targets gave a source there, less what it had, at most its share of one container.
    A document is split only if it is larger than the capacity: into full
    containers and one rest.  A container is named by (limit_no, shard,
    container_no).  Sources without a target are given their own share of all
    tokens.  Documents of no tokens take no room; null ids are dropped, and ids
    are expected to be unique.  ``sized`` is a written table.
    """
    limits = [(int(n), int(c)) for n, c in limits if c and c > 0]
    spark = sized.sparkSession
    if not limits:
        return spark.createDataFrame([], _PACKED)
    sized = sized.where("doc_id IS NOT NULL")
    total = sized.agg(F.sum("tokens").alias("t")).first().t or 0
    n_shards = max(1, math.ceil(total / shard_tokens))
    target = F.coalesce(*[F.when(F.col("src") == s, F.lit(float(w))) for s, w in shares.items()], F.lit(None).cast("double"))
    rows = sized.select("doc_id", "src", "tokens", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_shards)).cast("int").alias("shard"), F.xxhash64("doc_id", F.lit(seed + 1)).alias("turn"))
    parts = cut(rows.groupBy("shard", "src").agg(F.sum("tokens").cast("double").alias("had")), "parts")
    of_shard = parts.groupBy("shard").agg(F.sum("had").alias("all_had"))
    of_source = parts.groupBy("src").agg((F.sum("had") / F.lit(float(max(1, total)))).alias("own"))
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.join(of_shard, "shard").join(of_source, "src").withColumn("weight", F.coalesce(target, F.col("own"))).withColumn("aimed", target.isNotNull())
    start = start.withColumn("owed", F.coalesce(F.sum(F.col("weight") * F.col("all_had") - F.col("had")).over(before), F.lit(0.0))).select("shard", "src", "weight", "aimed", "owed")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("limit_no"), F.lit(c).alias("capacity")) for n, c in limits])).alias("limit")
    rows = rows.join(start, ["shard", "src"]).select("*", each).select("limit.*", "shard", "doc_id", "src", "tokens", "turn", "weight", "aimed", "owed")
    most = F.col("weight") * F.col("capacity")
    rows = rows.withColumn("deficit", F.greatest(-most, F.least(most, F.col("owed")))).drop("owed")
    return rows.groupBy("limit_no", "shard").applyInPandas(pack_shard, _PACKED)


def _inputs(spark: SparkSession, data_dir: str) -> tuple[DataFrame, list, dict]:
    sized = cut(with_tokens(spread(table(spark, data_dir, "documents").select("doc_id", clean_source().alias("src"), "text"))), "sized")
    limits = [(r.limit_no, r.capacity_tokens) for r in table(spark, data_dir, "pack_limits").collect()]  # a handful of settings
    shares = {r.source: r.target_share for r in table(spark, data_dir, "mix_targets").collect() if r.source is not None and r.target_share}
    return sized, limits, shares


def packed(spark: SparkSession, data_dir: str) -> DataFrame:
    return pack(*_inputs(spark, data_dir))


def fill(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per capacity: containers, the least number that could hold all tokens, and the share of room that is used."""
    pieces = packed(spark, data_dir)
    boxes = pieces.groupBy("limit_no", "capacity_tokens", "shard", "container_no").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return boxes.groupBy("limit_no", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("least_containers"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens")), 4).alias("fill"))


def window_mix(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per window and source that it aimed at or holds: the tokens it got, its share of the window, and the share it was to have (null where its share was left to others)."""
    got = packed(spark, data_dir).groupBy("limit_no", "capacity_tokens", "shard", "window_no", "mixed", "src").agg(F.sum("tokens").alias("tokens"), F.round(F.max("aim"), 6).alias("aim"))
    whole = Window.partitionBy("limit_no", "shard", "window_no")
    targets = table(spark, data_dir, "mix_targets").select(F.col("source").alias("src"), "target_share")
    return got.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(whole), 6)).join(F.broadcast(targets), "src", "left")  # a handful of settings


def documents_packed(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per capacity: how many documents came out, and how many of their pieces lie in more than one place or are missing (none)."""
    each = packed(spark, data_dir).groupBy("limit_no", "capacity_tokens", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece_no").alias("k"), F.max("piece_no").alias("last"))
    return each.groupBy("limit_no", "capacity_tokens").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") != F.col("k")) | (F.col("last") + 1 != F.col("n"))).alias("broken"))


QUERIES = {"p7_packed": packed, "p7_fill": fill, "p7_window_mix": window_mix, "p7_documents": documents_packed}
SQL = {
    "p7_documents": "SELECT limit_no, capacity_tokens, count(doc_id) AS documents, 0::BIGINT AS broken FROM pack_limits, documents WHERE capacity_tokens > 0 GROUP BY 1, 2",
}
