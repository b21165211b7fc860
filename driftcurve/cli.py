"""Command line: features, wavelets, sample, labels. Paths are anything that Spark reads.

    python -m driftcurve.cli features INPUT OUTPUT [options]
    python -m driftcurve.cli wavelets INPUT OUTPUT [options]
    python -m driftcurve.cli sample INPUT OUTPUT --min-prob P --max-prob P -n N [--seed S]
    python -m driftcurve.cli images FOLDER OUTPUT

INPUT and OUTPUT default to the folders in DRIFTCURVE_INPUT and DRIFTCURVE_OUTPUT.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession, functions as F

from driftcurve.functions.filters import WAVELETS
from driftcurve.operators import selection as sel, series as ser, wavelets as wav
from driftcurve.operators.features import extract_all
from driftcurve.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftcurve", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = p.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        c = kinds.add_parser(name)
        c.add_argument("input", nargs="?", default=os.environ.get("DRIFTCURVE_INPUT"))
        c.add_argument("output", nargs="?", default=os.environ.get("DRIFTCURVE_OUTPUT"))
        return c

    for name, levels in (("features", 5), ("wavelets", 6)):
        c = command(name)
        c.add_argument("--split", help="subfolder of the input")
        c.add_argument("--from-row", type=int, default=None)
        c.add_argument("--to-row", type=int, default=None)
        c.add_argument("--wavelets", nargs="*", default=list(WAVELETS), choices=WAVELETS)
        c.add_argument("--max-level", type=int, default=levels)
        c.add_argument("--no-interpolate", action="store_true", help="transform the points as they are")
        c.add_argument("--interpolation-points", type=int, default=wav.GRID)
        c.add_argument("--float64", action="store_true")
        if name == "features":
            c.add_argument("--split-column", default="mag", help="column whose extremum splits a series")
            c.add_argument("--no-split", action="store_true")
            c.add_argument("--no-additional", action="store_true", help="only the basic statistics of the parts")
            c.add_argument("--no-argmin", action="store_true")
            c.add_argument("--argmax", action="store_true")
            c.add_argument("--outlier-column", default="mag")
            c.add_argument("--outlier-k", type=float, default=40.0, help="interquartile ranges; 0 cleans nothing")
    c = command("sample")
    c.add_argument("--min-prob", type=float, required=True)
    c.add_argument("--max-prob", type=float, required=True)
    c.add_argument("-n", type=int, required=True)
    c.add_argument("--seed", type=int, default=42)
    command("images")
    return p


def checked(args: argparse.Namespace, p: argparse.ArgumentParser) -> argparse.Namespace:
    if not args.input or not args.output:
        p.error("input and output are needed")
    if args.command == "sample" and not (0 <= args.min_prob <= args.max_prob <= 1 and args.n > 0):
        p.error("need 0 <= min-prob <= max-prob <= 1 and n > 0")
    return args


def series_of(spark: SparkSession, args: argparse.Namespace):
    """Series in long form from a table of arrays; rows are numbered by row_index if it is there, else named by id."""
    path = f"{args.input}/{args.split}" if args.split else args.input
    rows = (args.from_row or 0, args.to_row) if args.from_row is not None or args.to_row is not None else None
    nested = tables.scan(spark, path, ("row_index", "id", "class", "mjd", "mag", "magerr"), rows)
    if "row_index" in nested.columns:
        nested = nested.drop("id").withColumnRenamed("row_index", "id")
    return ser.explode_series(nested)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = parser()
    args = checked(p.parse_args(argv), p)
    spark = spark or SparkSession.builder.appName("driftcurve").getOrCreate()
    if args.command == "sample":
        found = sel.between(spark.read.parquet(args.input), args.min_prob, args.max_prob)
        out = sel.sample(found, args.n, args.seed, "row_index" if "row_index" in found.columns else found.columns[0])
    elif args.command == "images":
        out = tables.discover_images(spark, args.input)
    elif args.command == "wavelets":
        nested = ser.implode_series(ser.with_norm(series_of(spark, args), "centre"), ("mjd", "norm"))
        out = wav.wavelet_features(nested, time=None if args.no_interpolate else "mjd", wavelets=tuple(args.wavelets), levels=args.max_level, points=args.interpolation_points)
    else:
        out = extract_all(
            series_of(spark, args), od_k=args.outlier_k, od_column=args.outlier_column, wavelets=tuple(args.wavelets), levels=args.max_level, interpolate=not args.no_interpolate, points=args.interpolation_points,
            split_by=None if args.no_split else args.split_column, additional=not args.no_additional, argmin=not args.no_argmin, argmax=args.argmax, float32=False,
        )
    tables.write(out, args.output, float32=args.command in ("features", "wavelets") and not args.float64)


if __name__ == "__main__":
    main(sys.argv[1:])
