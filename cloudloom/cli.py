"""Commands: ``python -m cloudloom.cli features ...`` and ``python -m cloudloom.cli demo ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import demo
from .features import features_for_residues
from .functions.columns import float_list
from .plans.config import SHEAVES, FeatureConfig
from .sources import pdb, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cloudloom")
    sub = top.add_subparsers(dest="command", required=True)
    f = sub.add_parser("features", help="feature tables of a folder of structure files")
    f.add_argument("--pdb-dir", required=True)
    f.add_argument("--pattern", default="*.pdb")
    f.add_argument("--out-dir", required=True)
    f.add_argument("--radii", default="6,9,12")
    f.add_argument("--sheaf", choices=SHEAVES, default="center_labeled")
    f.add_argument("--stats", default="both")
    f.add_argument("--degrees", default="0")
    f.add_argument("--p-widths", default="0")
    f.add_argument("--scale-labels", action="store_true")
    f.add_argument("--format", choices=("csv", "parquet"), default="csv")
    d = sub.add_parser("demo", help="features, leave-one-out fit and summary of a folder of structure files")
    d.add_argument("--pdb-dir", required=True)
    d.add_argument("--out-dir", required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cloudloom").getOrCreate()
    if args.command == "demo":
        print(json.dumps(demo.run(spark, args.pdb_dir, args.out_dir), indent=2))
        return 0
    degrees = tuple(int(x) for x in float_list(args.degrees))
    config = FeatureConfig(tuple(float_list(args.radii)), args.sheaf, args.stats, degrees, tuple(float_list(args.p_widths)), args.scale_labels)
    table = features_for_residues(pdb.read_structures(spark, args.pdb_dir, args.pattern), config)
    rows = sinks.write_features(table, f"{args.out_dir}/features", config.names(), args.format)
    sinks.write_sidecars(args.out_dir, config)
    print(f"{rows} rows, {len(config.names())} features")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
