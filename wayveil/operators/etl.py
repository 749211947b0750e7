"""From raw fixes and check-ins to trajectories of equal length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo


def iqr_filter(df: DataFrame, cols: tuple[str, ...] = ("lat", "lon"), k: float = 1.5) -> DataFrame:
    """Rows within k interquartile ranges of the exact quartiles on every column."""
    q = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"q_{c}") for c in cols])
    out = df.join(F.broadcast(q))  # one row
    for c in cols:
        lo, hi = F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]
        out = out.where(F.col(c).between(lo - k * (hi - lo), hi + k * (hi - lo)))
    return out.select(*df.columns)


def round_slot(ts: Column, minutes: int = 10) -> Column:
    """To the nearest slot by minute of day, seconds ignored; the last half slot falls to the next day."""
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts) + minutes // 2) / minutes) * minutes
    return F.date_trunc("DAY", ts) + F.make_dt_interval(F.lit(0), F.lit(0), slot.cast("int"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def time_window(df: DataFrame, ts: str = "slot", first: int = 510, last: int = 870) -> DataFrame:
    return df.where(minute_of_day(F.col(ts)).between(first, last))


def first_in_slot(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def complete_days(df: DataFrame, required: int, keys: tuple[str, str] = ("id", "date")) -> DataFrame:
    """Rows of (id, date) groups with exactly ``required`` rows; no self-join."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") == required).drop("_n")


def first_days(df: DataFrame, n: int) -> DataFrame:
    """The first n calendar dates; traj_id = id_date. The distinct dates, a few, are ranked, not the rows."""
    days = df.select("date").where("date is not null").distinct().orderBy("date").limit(n)
    return df.join(F.broadcast(days), "date", "left_semi").withColumn("traj_id", F.concat_ws("_", F.col("id").cast("string"), F.col("date").cast("string")))


def number_steps(df: DataFrame, key: str = "traj_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("int"))


def assert_rectangular(points: DataFrame, key: str = "traj_id") -> int:
    """The common length; raises if trajectories differ in length."""
    r = points.groupBy(key).count().agg(F.min("count"), F.max("count")).first()
    if r[0] != r[1]:
        raise ValueError(f"trajectories have between {r[0]} and {r[1]} points")
    return r[0] or 0


def bounds(points: DataFrame, pad: float = 0.01) -> DataFrame:
    return points.agg((F.min("x") - pad).alias("xl"), (F.max("x") + pad).alias("xu"), (F.min("y") - pad).alias("yl"), (F.max("y") + pad).alias("yu"))


def time_slice(points: DataFrame, tl: int, tu: int) -> DataFrame:
    return points.where(F.col("t").between(tl, tu)).withColumn("t", F.col("t") - tl)


def flatten(points: DataFrame, key: str = "traj_id") -> DataFrame:
    """One array x0, y0, x1, y1, ... a trajectory."""
    steps = F.array_sort(F.collect_list(F.struct("t", "x", "y")))
    return points.groupBy(key).agg(F.flatten(F.transform(steps, lambda p: F.array(p["x"], p["y"]))).alias("vec"))


def unflatten(vectors: DataFrame, key: str = "traj_id") -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("vec") / 2).cast("int") - 1), lambda t: F.struct(F.get("vec", 2 * t).alias("x"), F.get("vec", 2 * t + 1).alias("y")))
    return vectors.select(key, F.posexplode(pairs).alias("t", "p")).select(key, "t", "p.x", "p.y")


def clean_fixes(fixes: DataFrame, epsg: int = 32650, required: int = 37, minutes: int = 10) -> DataFrame:
    """id, ts (slot), date, x, y: outliers, slots, daytime window, first fix a slot, complete days, projection.

    Of fixes at one time in a slot the first file's stays, then by longitude and latitude: rows of a table have no order.
    """
    df = geo.guarded(iqr_filter(fixes)).withColumn("slot", round_slot(F.col("ts"), minutes))
    order = ["ts", *(["file"] if "file" in fixes.columns else []), "lon", "lat"]
    df = first_in_slot(time_window(df), ["id", "slot"], order).withColumn("date", F.to_date("slot"))
    x, y = geo.forward(F.col("lon"), F.col("lat"), epsg)
    return complete_days(df, required).select("id", F.col("slot").alias("ts"), "date", x.alias("x"), y.alias("y"))


def taxi_to_points(fixes: DataFrame, epsg: int = 32650, required: int = 37, days: int = 3, minutes: int = 10) -> DataFrame:
    """The whole way, of the first days."""
    return first_days(clean_fixes(fixes, epsg, required, minutes), days).select("traj_id", "ts", "date", "x", "y")


# Check-ins.

def presence(checkins: DataFrame) -> DataFrame:
    return checkins.select("user", F.to_date("ts").alias("date")).distinct()


def streaks(days: DataFrame, m: int, calendar: bool = False) -> DataFrame:
    """user, date, block of each full, non-overlapping run of m adjacent dates.

    Adjacent are dates next to each other among all dates observed, or calendar days.
    """
    if calendar:
        ranked = days.withColumn("k", F.datediff("date", F.lit("1970-01-01").cast("date")))
    else:
        every = days.select("date").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("date")))  # distinct dates only
        ranked = days.join(F.broadcast(every), "date")
    own = Window.partitionBy("user").orderBy("k")
    island = ranked.withColumn("island", F.col("k") - F.row_number().over(own))
    block = island.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("user", "island").orderBy("k")) - 1) / m).cast("long"))
    full = block.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user", "island", "block"))).where(F.col("n") == m)
    return full.withColumn("start", F.min("date").over(Window.partitionBy("user", "island", "block"))).select("user", "date", "start")


def number_streaks(rows: DataFrame) -> DataFrame:
    """traj_id by user and start: counts of earlier users' streaks, then the rank within the user; no single task ranks all."""
    heads = rows.select("user", "start").distinct()
    own = heads.withColumn("k", F.row_number().over(Window.partitionBy("user").orderBy("start")) - 1)
    counts = heads.groupBy("user").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("user").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = own.join(before, "user").select("user", "start", (F.col("before") + F.col("k")).alias("traj_id"))
    return rows.join(ids, ["user", "start"])


def streak_points(checkins: DataFrame, m: int, calendar: bool = False, order: tuple[str, ...] = ("ts", "location_id")) -> DataFrame:
    """The first check-in of each user and date of a streak, with the streak's traj_id."""
    named = number_streaks(streaks(presence(checkins), m, calendar)).select("user", "date", "traj_id")
    dated = checkins.withColumn("date", F.to_date("ts"))
    first = first_in_slot(dated.join(named, ["user", "date"]), ["user", "date"], list(order))
    return first


def streak_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("user").alias("users"), F.count_distinct("user", "start").alias("streaks"))
