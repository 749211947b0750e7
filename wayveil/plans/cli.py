"""Entries beside the experiment harness: the baseline's experiment, raw logs, check-in streaks, one trajectory."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import etl
from ..sources import readers
from . import harness


def clean_logs(spark: SparkSession, source: str, target: str, days: tuple[int, ...] = (1, 3, 7), **options) -> None:
    """Raw logs to one point table for each number of days: ``target``/1.csv and so on. The logs are cleaned once."""
    every = etl.clean_fixes(readers.taxi_logs(spark, source), **options).persist()
    for n in days:
        readers.write(etl.first_days(every, n).select("traj_id", "ts", "date", "x", "y"), f"{target}/{n}.csv")
    every.unpersist()


def write_streaks(spark: SparkSession, source: str, target: str, m: int) -> None:
    """The first check-in of each day of all streaks of m days: ``target``/m.csv."""
    readers.write(etl.streak_points(readers.checkins(spark, source), m), f"{target}/{m}.csv")


def one_trajectory(points: DataFrame, traj_id: object) -> DataFrame:
    """The rows of one trajectory in order of time; the filter reaches the scan."""
    return points.where(F.col("traj_id") == F.lit(traj_id)).orderBy("t" if "t" in points.columns else "ts")


def main(argv: list[str] | None = None) -> int:
    """python -m wayveil.plans.cli baseline points.csv out | clean logs out | streaks checkins out m | show points.csv id"""
    parser = argparse.ArgumentParser(description=main.__doc__)
    kinds = parser.add_subparsers(dest="what", required=True)
    for what, last in (("baseline", "target"), ("clean", "target"), ("streaks", "target"), ("show", "traj_id")):
        sub = kinds.add_parser(what)
        sub.add_argument("source")
        sub.add_argument(last)
        if what == "baseline":
            sub.add_argument("--runs", type=int, default=16)
        if what == "streaks":
            sub.add_argument("m", type=int)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.what == "baseline":
        points, box = harness.dataset(spark, args.source)
        harness.run_all(points, box, harness.BASELINE_COMBINATIONS, args.runs, harness.baseline_mechanism, 1, args.target)
    elif args.what == "clean":
        clean_logs(spark, args.source, args.target)
    elif args.what == "streaks":
        write_streaks(spark, args.source, args.target, args.m)
    else:
        one_trajectory(readers.point_table(spark, args.source), args.traj_id).show(1000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
