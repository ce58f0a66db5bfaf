"""``python -m corpusmill``: queries over a data folder, and recomputing and reporting a run of a store."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import geometry, reports
from .plans import registry
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    query = commands.add_parser("query", help="runs a query and shows it, or writes it as Parquet")
    query.add_argument("name", choices=sorted(registry.QUERIES), metavar="NAME")
    query.add_argument("data")
    query.add_argument("--out")
    recompute = commands.add_parser("recompute", help="scores of a run anew")
    recompute.add_argument("--k", type=int, default=geometry.DEFAULT_K, help="principal axes to remove")
    recompute.add_argument("--strength", type=float, default=geometry.DEFAULT_STRENGTH, help="share of the common direction to remove")
    recompute.add_argument("--self", dest="own", nargs="*", default=[], help="hosts of the corpus itself")
    report = commands.add_parser("report", help="report of a run as Markdown")
    report.add_argument("--judge", help="the newest verdicts where it is left out")
    report.add_argument("--min-n", type=int, default=10, help="papers that a topic needs for a correlation")
    report.add_argument("--out", help="a file; shown where it is left out")
    for command in (recompute, report):
        command.add_argument("store")
        command.add_argument("--run", default="baseline")
    return out


def main(args: list[str]) -> int:
    asked = parser().parse_args(args)
    if asked.command == "list":
        print(*sorted(registry.QUERIES), sep="\n")
        return 0
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    if asked.command == "query":
        df = registry.QUERIES[asked.name](spark, asked.data)
        if asked.out:
            df.write.parquet(asked.out)
        else:
            df.show(truncate=60)
    elif asked.command == "recompute":
        from .functions.text import self_reference

        reports.recompute_run(Store(spark, asked.store), self_reference(F.col("pdf_path"), asked.own), asked.k, asked.strength, F.current_timestamp(), asked.run)
    else:
        text, _ = reports.main_report(Store(spark, asked.store), asked.run, asked.judge, asked.min_n)
        if asked.out:
            with open(asked.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
