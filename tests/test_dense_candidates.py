"""Candidates of the dense form are not shuffled, and none that reaches the threshold is lost."""

import pytest
from pyspark.sql import functions as F

from wayveil.functions import noise
from wayveil.operators import grid as G
from wayveil.operators import publish


@pytest.mark.parametrize("few", [-1, 1_000_000])
def test_all_candidates_and_no_shuffle_of_them(spark, monkeypatch, few):
    monkeypatch.setattr(G, "BROADCAST_CELLS", few)
    cfg = publish.PublishConfig(40.0, 0, 1, G.GridConfig(40.0), seed="p")
    paths = spark.range(60).select(F.array(F.col("id").cast("int")).alias("path"))
    areas = spark.range(70).select(F.col("id").cast("int").alias("area_id"))
    true = spark.range(30).select(F.array((F.col("id") * 2).cast("int"), F.col("id").cast("int")).alias("path"), F.lit(2).cast("long").alias("c"))
    eps, threshold = 1.3, 1.7
    got = publish._noisy(paths, areas, true, eps, threshold, cfg)
    plain = paths.crossJoin(areas).select(F.concat("path", F.array("area_id")).alias("path")).join(true, "path", "left")
    plain = plain.withColumn("v", F.coalesce("c", F.lit(0)) + noise.laplace(eps, "p", F.lit("path"), F.array_join("path", "-"))).where(F.col("v") >= threshold)
    want = sorted((r.path, r.cnt) for r in plain.select("path", F.bround("v").cast("long").alias("cnt")).collect())
    assert sorted((r.path, r.cnt) for r in got.collect()) == want and len(want) > 100
    if few > 0:  # only the prefixes are dealt
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
