"""Summaries of result tables: what figures would be drawn from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def where_params(df: DataFrame, **params) -> DataFrame:
    """A value: equal; a list: one of them; all conditions together."""
    for name, v in params.items():
        df = df.where(F.col(name).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(name).eqNullSafe(F.lit(v)))
    return df


def with_span(df: DataFrame) -> DataFrame:
    return df.withColumn("t_span", F.col("tu") - F.col("tl") + 1)


def normalised(df: DataFrame, distance: str, to: str = "normalised") -> DataFrame:
    """Distance by step: d / sqrt(2 t_span)."""
    return df.withColumn(to, F.col(distance) / F.sqrt(2 * F.col("t_span")))


def meaningful(df: DataFrame, by: list[str], value: str = "normalised", weight: str = "count", below: float = 500.0) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col(value) < below, F.col(weight))), F.lit(0)).alias("meaningful"))


def stack(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Variants under one another, missing columns null, each with its name in column ``tag``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(n)) for n, df in frames.items()])


def remap(df: DataFrame, col: str, values: dict[str, str]) -> DataFrame:
    return df.replace(values, subset=[col])


def levels(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().na.drop().orderBy(col)


def boxplot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles and whiskers (the furthest values within 1.5 ranges of the box)."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return df.join(q, by).groupBy(*by).agg(*[F.first(c).alias(c) for c in ("q1", "median", "q3")], F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))


def bar_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and 95 % normal interval."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("lo"), (F.avg(value) + half).alias("hi"))


def kde(df: DataFrame, value: str, lo: float, hi: float, points: int, bandwidth: float, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian density at ``points`` places from lo to hi. Each row adds to every place map-side, so what is shuffled is places."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = F.lit(lo) + F.col("i") * ((hi - lo) / (points - 1))
    z = (F.col("x") - F.col(value)) / bandwidth
    grid = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    dens = grid.groupBy(*by, "i").agg(F.first("x").alias("x"), (F.sum(w * F.exp(-0.5 * z * z)) / (bandwidth * F.sqrt(2 * F.pi()) * F.sum(w))).alias("density"))
    return dens.drop("i")


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int = 100) -> DataFrame:
    """bin (from 0), density; the last bin holds its upper edge."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    inside = df.where(F.col(value).between(lo, hi)).withColumn("bin", b)
    counts = inside.groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    n = inside.agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(n)).select("bin", (F.col("c") / (F.col("n") * width)).alias("density"))


def grid_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("t").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("area_id").alias("areas"), F.sum("cnt").alias("cnt"))
