import os
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

DATA = "/root/testdata/sf0.001"

SCHEMAS = {
    "collection_tsv": "doc_id BIGINT, doc_in STRING, feed STRING, read_at TIMESTAMP",
    "term_stream": "add_id BIGINT, block_no INT, term STRING, doc_id BIGINT, pos INT, logged_at TIMESTAMP",
    "lexicon_line": "block_no INT, term STRING, cf INT, df INT, offset_doc_id BIGINT, offset_tf BIGINT, len_of_doc_id INT, len_of_tf INT, n_block INT, offset_skip_blocks BIGINT",
    "lexicon_line_final": "shard_no INT, term STRING, cf INT, df INT, n_block INT, offset_skip_blocks BIGINT, term_upper_bound_tfidf FLOAT, term_upper_bound_bm25 FLOAT",
    "doc_table": "doc_id BIGINT, dl INT",
    "queries_test": "line_no BIGINT, qid INT, text STRING",
    "stop_words": "word STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, publisher STRING, fetched_at TIMESTAMP",
    "mix_targets": "source STRING, target_share DOUBLE, max_repeats INT",
    "pack_limits": "limit_no INT, capacity_tokens INT",
}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def tables(spark, tmp_path):
    """Writes the given tables, and empty ones for all others, and gives their folder."""

    def write(extra: str = "", **rows):
        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame(rows.get(name, []), schema)
            if extra and name in rows:
                for c in set(extra.split(",")) - set(df.columns):
                    df = df.selectExpr("*", f"'x' AS `{c}`")
            df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, (float, np.floating)) else str(v)

    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [cell(float(v)) if df[c].dtype.kind == "f" else cell(v) for v in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture
def same_as_sql(spark):
    """Compares a query with its SQL over a folder of tables."""

    def check(query, sql, data=DATA):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for p in Path(data).iterdir():
            if p.suffix == ".parquet":
                con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        ours, theirs = normal(query(spark, str(data)).toPandas()), normal(con.execute(sql).fetchdf())
        assert list(ours.columns) == list(theirs.columns)
        pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)
        return ours

    return check
