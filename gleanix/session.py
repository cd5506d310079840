"""Places for intermediate tables, shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only where
    that is unset (local tests) a temporary folder of this machine is taken,
    which is safe because driver and executors are then one process.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="gleanix-")
        _SCRATCH[app] = f"{base.rstrip('/')}/gleanix-{uuid.uuid4().hex}"
    return _SCRATCH[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used, inside the scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where a result is read more than once or where a loop would let the
    lineage grow.  A lost executor costs nothing: the files are in the shared
    folder, not on the executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(scan: DataFrame) -> int:
    """Tasks for a step that costs much for each row of ``scan``, a table with at most filters and projections on it."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, 2 * scan.rdd.getNumPartitions())


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many parts as there are cores: a small input lies in one file, which one core would read alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def purge_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables.  Results not yet written become unreadable."""
    path = _SCRATCH.pop(spark.sparkContext.applicationId, None)
    if path:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
