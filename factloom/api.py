"""The calls a user of the engine makes, and a small command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import __version__, queries
from factloom.operators.predicates import unknown_values
from factloom.session import get_session, release
from factloom.sources.tables import table


def health(spark: SparkSession, sf: str) -> dict[str, int]:
    """Rows per table of the store."""
    names = ("companies", "filings", "filing_sections", "xbrl_facts", "chunks")
    return {n: table(spark, sf, n).count() for n in names}


def version() -> str:
    return __version__


def tickers(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker) of the universe, in capitals, each once."""
    return table(spark, sf, "companies").select(F.upper("ticker").alias("ticker")).where("ticker IS NOT NULL").distinct()


def check_universe(requested: list[str], allowed: list[str]) -> None:
    """Raise ValueError for tickers outside the universe."""
    if unknown := unknown_values([t.upper() for t in requested], [t.upper() for t in allowed]):
        raise ValueError(f"unknown tickers: {', '.join(unknown)}")


def stop(spark: SparkSession, tag: str) -> None:
    """Cancel the running jobs that were started under ``spark.addTag(tag)``."""
    spark.interruptTag(tag)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factloom")
    parser.add_argument("data", help="folder of Parquet tables")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("health")
    run = commands.add_parser("run", help="run a registered query and write its result")
    run.add_argument("name")
    run.add_argument("out")
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "orc"])
    args = parser.parse_args(argv)
    spark = get_session()
    if args.command == "health":
        print(json.dumps(health(spark, args.data)))
    else:
        queries.collect()[0][args.name](spark, args.data).write.mode("errorifexists").format(args.format).save(args.out)
        release(spark)


if __name__ == "__main__":
    main()
