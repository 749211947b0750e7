"""An extension beyond batch: the slot cleaning of the batch path over a stream of fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.etl import minute_of_day, round_slot


def clean_stream(fixes: DataFrame, delay: str = "30 minutes", first: int = 510, last: int = 870) -> DataFrame:
    """id, slot, lon, lat: the first fix to arrive of each vehicle and slot, within the daytime window."""
    late = fixes.withWatermark("ts", delay).withColumn("slot", round_slot(F.col("ts")))
    day = late.where(minute_of_day(F.col("slot")).between(first, last))
    return day.dropDuplicatesWithinWatermark(["id", "slot"]).select("id", "slot", "lon", "lat")


def fixes_per_slot(fixes: DataFrame, delay: str = "30 minutes", length: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; closed once the watermark has passed."""
    return fixes.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
