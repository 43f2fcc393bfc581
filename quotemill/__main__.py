"""Command line: `python -m quotemill parse DOCUMENTS.parquet OUT`, `... print DOCUMENTS.parquet` (JSON to standard output,
a document a line) or `... info DOCUMENTS.parquet`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quotemill.operators import parsing
from quotemill.runtime import ship
from quotemill.sources import sinks


def main() -> None:
    parser = argparse.ArgumentParser(prog="quotemill")
    parser.add_argument("command", choices=["parse", "print", "info"])
    parser.add_argument("documents", help="Parquet with doc_id and text")
    parser.add_argument("out", nargs="?", help="folder for JSON results")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("quotemill").getOrCreate()
    ship(spark)
    docs = spark.read.parquet(args.documents).select("doc_id", "text")
    if args.command == "parse":
        sinks.write_json(parsing.results(docs), args.out or "results_parsed")
    elif args.command == "print":
        for row in sinks.as_json(parsing.results(docs)).select("json").toLocalIterator():  # one partition at a time
            print(row["json"])
    else:
        sinks.overview(parsing.parse_quotes(docs)).show(truncate=False)


if __name__ == "__main__":
    main()
