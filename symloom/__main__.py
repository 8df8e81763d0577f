"""python -m symloom analyze|architecture|health|impact|serve: a thin command line over the facade."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from symloom.model import Graph
from symloom.plans.engine import Engine, serve
from symloom.plans.ingest import populate
from symloom.sources.workspace import Config


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="symloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="scan a source tree and write its graph")
    a.add_argument("root")
    a.add_argument("out")
    a.add_argument("--files", type=int, help="write functions and calls in so many files by key, with an index of names")
    a.add_argument("--config", help="a configuration file: the fields of embedded texts")
    for name in ("architecture", "health", "serve"):
        sub.add_parser(name).add_argument("graph")
    i = sub.add_parser("impact")
    i.add_argument("graph")
    i.add_argument("function")
    i.add_argument("--depth", type=int, default=3)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("symloom").getOrCreate()
    if args.command == "analyze":
        config = Config.loads(Path(args.config).read_text()) if args.config else Config()
        Engine(populate(spark, args.root, args.out, files=args.files, fields=config.fields)).call("initialize").show(truncate=False)
        return 0
    engine = Engine(Graph.read(spark, args.graph), at=args.graph)
    if args.command == "serve":
        serve(engine, sys.stdin, sys.stdout)
    elif args.command == "impact":
        engine.call("analyze_change_impact", {"function": args.function, "depth": args.depth}).show(50, truncate=False)
    else:
        engine.call({"architecture": "check_architecture_violations", "health": "get_layer_health"}[args.command]).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
