"""Postings of arriving documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gleanix.functions.text import analyse
from gleanix.operators.index import postings


def postings_stream(arrivals: DataFrame, path: str, checkpoint: str, stop: Iterable[str] | None = None, stemmed: bool = False) -> StreamingQuery:
    """Write the postings of a stream of (doc_id, text) under ``path``, one folder ``batch=<n>`` a micro-batch.

    Runs until what has arrived is worked off.  A batch that is run again after
    a failure overwrites its own folder, so that nothing is written twice.
    Documents have to arrive whole and once; read ``path`` as one table of
    (term, doc_id, tf, dl, batch).
    """
    stop = None if stop is None else sorted(set(stop))

    def write(batch: DataFrame, number: int) -> None:
        rows = postings(analyse(batch.select("doc_id", "text"), "text", stop, stemmed))
        rows.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
