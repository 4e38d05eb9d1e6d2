"""Runs a named query: ``python -m lodeflow QUERY INPUT OUTPUT [--conf key=value ...] [--format parquet]``; ``--list`` names them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodeflow.plans import catalogue


def main(args: list[str] | None = None) -> int:
    """0 when the result is written; 2 for a query that isn't known, as for other wrong arguments."""
    p = argparse.ArgumentParser(prog="lodeflow")
    p.add_argument("--list", action="store_true", help="name the queries")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="a setting of the session")
    p.add_argument("--format", default="parquet", help="of the output, as Spark names it")
    p.add_argument("words", nargs="*", metavar="QUERY INPUT OUTPUT")
    found = p.parse_args(args)
    if found.list:
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if len(found.words) != 3 or found.words[0] not in catalogue.QUERIES:
        p.print_usage(sys.stderr)
        return 2
    builder = SparkSession.builder.appName(f"lodeflow {found.words[0]}")
    for setting in found.conf:
        builder = builder.config(*setting.partition("=")[::2])
    name, source, out = found.words
    catalogue.QUERIES[name](builder.getOrCreate(), source).write.format(found.format).save(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
