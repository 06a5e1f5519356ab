"""Command line: ``python -m strataview FORMAT PATH [--field F] [--ts F] [--key F] [--limit N] [--out DIR]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strataview.plans.profile import cardinalities, profile
from strataview.plans.render import build, collect_nodes, declaration
from strataview.sources.tables import open_source, validate


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strataview", description=__doc__)
    parser.add_argument("kind")
    parser.add_argument("name")
    parser.add_argument("--field", default=0)
    parser.add_argument("--ts")
    parser.add_argument("--key")
    parser.add_argument("--limit", type=int, default=1000, help="records to read; 0: all")
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if problem := validate(spark, args.kind, args.name):
        print(problem)
        return 1
    attrs = {k: v for k, v in (("ts", args.ts), ("key", args.key)) if v}
    spec = profile(open_source(spark, args.kind, args.name), (args.field, attrs) if attrs else args.field, limit=args.limit or None, output_path=args.out)
    view = spec.postproc()
    print(declaration(build(collect_nodes(view.nodes), fields=view.meta["fields"], records=view.meta["records"])))
    cardinalities(view).orderBy("path", "class").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
