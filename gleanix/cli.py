"""Command line: build an index, ask it, run a query file.

python -m gleanix.cli build COLLECTION.tsv INDEX [--stem --stop WORDS.txt]
python -m gleanix.cli ask INDEX [--stem] [--mode and] [--scoring bm25] [-k 3]
python -m gleanix.cli run INDEX QUERIES.tsv RUN [--stem] [--scoring bm25]
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from gleanix.operators.index import Index, build_index, load_index, stop_list
from gleanix.operators.search import batch_run, search
from gleanix.sources.tables import read_collection_tsv, read_queries_tsv, write_run


def ask(index: Index, lines: Iterable[str], mode: str, scoring: str, k: int) -> None:
    """Answer every line: ranks, ids and scores, and the time it took."""
    for line in lines:
        began = time.perf_counter()
        rows = search(line.rstrip("\n"), index, mode, scoring, k).orderBy("rank").collect()
        for r in rows:
            print(f"{r['rank']}\t{r.doc_id}\t{r.score}")
        if not rows:
            print("no result")
        print(f"{time.perf_counter() - began:.3f} s", file=sys.stderr)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gleanix", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["build", "ask", "run"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--stem", action="store_true", help="the variant with stems")
    parser.add_argument("--stop", help="file of stop words, one a line")
    parser.add_argument("--mode", choices=["or", "and"], default="or")
    parser.add_argument("--scoring", choices=["tfidf", "bm25"], default="tfidf")
    parser.add_argument("-k", type=int, default=3)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("gleanix").getOrCreate()
    if a.command == "build":
        stop = stop_list(spark.read.text(a.stop)) if a.stop else None
        index = build_index(read_collection_tsv(spark, a.paths[0]), a.paths[1], stop, a.stem)
        print(f"{index.n_docs} documents")
    elif a.command == "ask":
        ask(load_index(spark, a.paths[0], a.stem), sys.stdin, a.mode, a.scoring, a.k)
    else:
        index = load_index(spark, a.paths[0], a.stem)
        write_run(batch_run(read_queries_tsv(spark, a.paths[1]), index, a.scoring), a.paths[2])


if __name__ == "__main__":
    main()
