"""Sources and sinks: raw logs, point tables, check-ins, results, generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import noise

TAXI = "id long, ts timestamp, lon double, lat double"
CHECKIN = "user string, ts timestamp, lat double, lon double, location_id long"
POINTS = "traj_id string, ts timestamp, date date, x double, y double"


def taxi_logs(spark: SparkSession, path: str) -> DataFrame:
    """Headerless logs, one file per vehicle; the file's name breaks ties later."""
    df = spark.read.schema(TAXI).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return df.withColumn("file", F.col("_metadata.file_name"))


def checkins(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Headerless check-ins; without ``sep`` the separator is sniffed from one line."""
    if sep is None:
        line = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
        sep = max("\t,;|", key=line.count)
    return spark.read.schema(CHECKIN).csv(path, sep=sep)


def point_table(spark: SparkSession, path: str) -> DataFrame:
    """A headered CSV of points, or a Parquet folder."""
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(POINTS).csv(path, header=True)


def results(spark: SparkSession, path: str) -> DataFrame:
    """A result table that :func:`write` made."""
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def write(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV with header, or Parquet if the path says so; one folder per value of ``by``."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*by) if by else w
    w.parquet(path) if path.endswith(".parquet") else w.csv(path, header=True)


def random_points(spark: SparkSession, n: int, steps: int, bounds: tuple[float, float, float, float], seed: str = "r") -> DataFrame:
    """n trajectories of uniform points in (xl, xu, yl, yu); generated where they are used."""
    xl, xu, yl, yu = bounds
    ids = spark.range(n).select(F.col("id").alias("traj_id"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"))
    return ids.select("traj_id", "t", noise.in_box(F.lit(xl), F.lit(xu), seed, F.lit("x"), "traj_id", "t").alias("x"), noise.in_box(F.lit(yl), F.lit(yu), seed, F.lit("y"), "traj_id", "t").alias("y"))


def literal_points(spark: SparkSession, paths: list[list[tuple[float, float]]]) -> DataFrame:
    rows = [(i, t, float(x), float(y)) for i, p in enumerate(paths) for t, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "traj_id long, t int, x double, y double")


# Stand-ins built from the test tables.

def vectors_as_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = e.select(F.col("vec_id").alias("traj_id"), "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda t: F.struct(F.get("embedding", 2 * t).alias("a"), F.get("embedding", 2 * t + 1).alias("b")))).alias("t", "p"))
    return e.select("traj_id", "label", "t", (10000 * F.col("p.a").cast("double")).alias("x"), (10000 * F.col("p.b").cast("double")).alias("y"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def event_chunks(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    from pyspark.sql.window import Window

    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = _events(spark, sf_dir).withColumn("rn", rn).withColumn("chunk", F.floor(F.col("rn") / size).cast("long"))
    full = e.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("user_id", "chunk"))).where(F.col("c") == size)
    return full.select(F.concat_ws("_", F.col("user_id").cast("string"), F.col("chunk").cast("string")).alias("traj_id"), (F.col("rn") % size).cast("int").alias("t"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


def event_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").cast("long").alias("id"), "ts", "event_id", (115.9 + F.col("value") / 1000).alias("lon"), (39.6 + F.col("k") * F.lit(0.005)).alias("lat"))


def event_checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user"), "ts", "event_id", (39.6 + F.col("k") * F.lit(0.005)).alias("lat"), (115.9 + F.col("value") / 1000).alias("lon"), F.col("k").cast("long").alias("location_id"))
