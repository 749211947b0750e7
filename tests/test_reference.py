"""Golden values, invariants and plans of the trajectory operators."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from wayveil.functions import geo, noise
from wayveil.operators import analysis, baseline, cluster, etl, metrics, publish
from wayveil.operators import grid as G
from wayveil.plans import harness
from wayveil.sources import readers

BOX10 = (0.0, 10.0, 0.0, 10.0)
TOY = [[(4, 4), (6, 4), (8, 4)], [(2, 2), (4, 2), (6, 2)], [(3, 1), (5, 1), (7, 1)]]


def toy(spark):
    return readers.literal_points(spark, TOY)


def toy_config(**more):
    grid = G.GridConfig(1.0, randomize=False, seed="s", **more)
    return publish.PublishConfig(1.0, 0, 1, grid, randomize=False)


def test_noise_free_toy(spark):
    paths, g = publish.publish(toy(spark), BOX10, toy_config())
    out = publish.post_process(paths, g).orderBy("pub_id", "t").collect()
    got = sorted(tuple((r.x - 0.5, r.y - 0.5) for r in out if r.pub_id == p) for p in {r.pub_id for r in out})
    assert got == [((2, 2), (4, 2)), ((3, 1), (5, 1)), ((4, 4), (6, 4))]
    assert all(math.isclose(r.u, math.sqrt(2) / 2) for r in out)


@pytest.mark.parametrize("sample,uniform", [(False, True), (True, False), (True, True)])
def test_post_process_stays_in_cells(spark, sample, uniform):
    paths, g = publish.publish(toy(spark), BOX10, toy_config(n_clusters=2))
    out = publish.post_process(paths, g, sample=sample, uniform=uniform).collect()
    assert len(out) == 2 * sum(r.cnt for r in paths.collect())
    assert all(0 <= r.x < 10 and 0 <= r.y < 10 for r in out)
    if sample and uniform:
        assert {r.u for r in out} == {0.0}


def test_range_query_demo(spark):
    walk = [(49.013996, 8.419688), (49.011199, 8.418734), (49.011998, 8.416847), (49.012797, 8.412196)]
    rows = [(1, t, lon, lat, u) for t, ((lat, lon), u) in enumerate(zip(walk, (100.0, 50.0, 40.0, 120.0)))]
    x, y = geo.forward(F.col("lon"), F.col("lat"), 25832)
    pts = spark.createDataFrame(rows, "traj_id long, t int, lon double, lat double, u double").withColumns({"x": x, "y": y})
    qs = [("psi1", 49.011316, 8.416873, 100.0), ("psi0", 49.010583, 8.412597, 120.0), ("dai1", 49.012758, 8.415633, 450.0), ("dai0", 49.012758, 8.415633, 350.0)]
    q = spark.createDataFrame(qs, "q_id string, lat double, lon double, r double").select("q_id", x.alias("qx"), y.alias("qy"), "r", F.lit(0).alias("tb"), F.lit(3).alias("te"))
    got = {r.q_id: r for r in metrics.range_counts(pts, q).collect()}
    assert got["psi1"].psi == 1 and got["psi0"].psi == 0 and got["dai1"].dai == 1 and got["dai0"].dai == 0
    late = q.withColumn("tb", F.lit(9)).withColumn("te", F.lit(9))
    assert all(r.psi == 0 and r.dai == 1 for r in metrics.range_counts(pts, late).collect())


def test_slots(spark):
    rows = [("2008-02-02 23:56:10",), ("2008-02-02 15:34:59",), ("2008-02-02 15:35:00",)]
    df = spark.createDataFrame(rows, "s string").select(etl.round_slot(F.to_timestamp("s")).alias("t"))
    assert [r.t for r in df.collect()] == [dt.datetime(2008, 2, 3), dt.datetime(2008, 2, 2, 15, 30), dt.datetime(2008, 2, 2, 15, 40)]


def test_streaks(spark):
    day = lambda d: dt.date(2020, 1, d)
    own = [("a", day(d)) for d in (1, 2, 3, 4, 5, 7, 8, 9)]
    blocks = lambda rows, **k: sorted((r.start.day, r.date.day) for r in etl.streaks(spark.createDataFrame(rows, "user string, date date"), 3, **k).collect() if r.user == "a")
    apart = [(1, 1), (1, 2), (1, 3), (7, 7), (7, 8), (7, 9)]
    assert blocks([*own, ("b", day(6))]) == apart
    assert blocks(own) == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (4, 7)]
    assert blocks(own, calendar=True) == apart


def test_projection(spark):
    x, y = geo.forward(F.lit(116.51172), F.lit(39.92123), 32650)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 458272.624) < 1e-2 and abs(r.y - 4419128.682) < 1e-2
    with pytest.raises(ValueError):
        geo.zone(1)
    bad = spark.createDataFrame([(10.0, 100.0)], "lon double, lat double")
    with pytest.raises(Exception, match="latitude"):
        geo.guarded(bad).collect()


def test_noise_statistics(spark):
    n = 40_000
    r = spark.range(n).select(noise.laplace(2.0, "x", "id").alias("v")).agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).first()
    assert abs(r.m) < 0.02 and abs(r.s - 0.5) < 0.03
    u = spark.range(n).select((noise.laplace(1.0, "y", "id") >= 2 * math.sqrt(2)).cast("int").alias("v")).agg(F.avg("v")).first()[0]
    assert abs(u - 0.5 * math.exp(-2 * math.sqrt(2))) < 0.004
    a = spark.range(100).select(noise.uniform("z", "id").alias("u")).collect()
    assert a == spark.range(100).repartition(3).orderBy("id").select(noise.uniform("z", "id").alias("u")).collect()


def test_budget(spark):
    *_, ledger = publish.budgets(toy_config())
    assert ledger.used() == pytest.approx(0.75)
    with pytest.raises(ValueError):
        ledger.spend("more", 0.3)


def test_grid_invariants(spark):
    pts = readers.random_points(spark, 300, 2, (0.0, 100.0, 0.0, 100.0))
    box = (0.0, 100.0, 0.0, 100.0)
    for divisor in ("m2", "m2sq"):
        cfg = G.GridConfig(20.0, randomize=False, leaf_divisor=divisor)
        res = G.resolutions(pts, box, cfg)
        located = G.locate_l1(pts, res, box)
        l1 = G.l1_cells(located, res, cfg)
        assert {r.s for r in l1.groupBy("t").agg(F.sum("n1").alias("s")).collect()} == {300.0}
        inf = G.infer(G.l2_cells(located, l1, box, cfg), cfg)
        assert inf.where(F.abs(F.col("cnt") - F.col("n2")) > 1e-9).isEmpty()
        area = inf.groupBy("t").agg(F.sum((F.col("xu") - F.col("xl")) * (F.col("yu") - F.col("yl"))).alias("a")).collect()
        assert all(abs(r.a - 10_000) < 1e-6 for r in area)
    noisy = G.GridConfig(20.0, leaf_divisor="m2sq")
    res = G.resolutions(pts, box, noisy)
    located = G.locate_l1(pts, res, box)
    inf = G.infer(G.l2_cells(located, G.l1_cells(located, res, noisy), box, noisy), noisy)
    root = inf.groupBy("t", "i1", "j1").agg(F.sum("cnt").alias("s"), F.first("n1").alias("n1"), F.first("S").alias("S"), F.first("m2").alias("m")).collect()
    assert all(abs(r.s - (0.25 * r.m**2 * r.n1 + 0.25 * r.S) / (0.25 * r.m**2 + 0.25)) < 1e-6 for r in root)
    assert G.rejected(spark.createDataFrame([(1, 0, 100.0, 5.0)], "traj_id long, t int, x double, y double"), box).count() == 1
    with pytest.raises(ValueError):
        G.policy(G.M1, "none")


def test_assignment_plan_is_an_equi_join(spark):
    g = G.build(toy(spark).where("t <= 1"), BOX10, G.GridConfig(1.0, randomize=False))
    plan = g.assigned._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_noisy_and_sparse_publishing(spark):
    pts = readers.random_points(spark, 200, 2, BOX10)
    base = dict(eps=40.0, tl=0, tu=1, grid=G.GridConfig(40.0, seed="q"), seed="q")
    dense, _ = publish.publish(pts, BOX10, publish.PublishConfig(**base))
    sparse, _ = publish.publish(pts, BOX10, publish.PublishConfig(**base, sparse=True))
    a, b = dense.count(), sparse.count()
    assert a and 0.7 < b / a < 1.4


def test_empty_publication(spark):
    none = spark.createDataFrame([], "path array<int>, cnt long")
    _, g = publish.publish(toy(spark), BOX10, toy_config())
    assert publish.post_process(none, g).count() == 0
    assert publish.post_process(spark.createDataFrame([([0], -3)], "path array<int>, cnt long"), g).count() == 0


def test_hausdorff(spark):
    v = etl.flatten(toy(spark)).select("vec")
    assert metrics.hausdorff(v, v).first().hausdorff == 0
    w = spark.createDataFrame([([4.0, 4.0, 6.0, 4.0, 8.0, 5.0],)], "vec array<double>")
    assert metrics.hausdorff(v, w).first().hausdorff == metrics.hausdorff(w, v).first().hausdorff > 1
    assert etl.unflatten(etl.flatten(toy(spark))).count() == 9
    assert etl.assert_rectangular(toy(spark)) == 3
    with pytest.raises(ValueError):
        etl.assert_rectangular(toy(spark).where("traj_id > 0 or t > 0"))


def test_baseline_pieces(spark):
    moves = [baseline.Move(1, 0, 1, 0.1), baseline.Move(2, 0, 1, 0.2), baseline.Move(1, 0, 2, 0.3)]
    sets = baseline.beam(moves, 10)
    assert sets[0] == (moves[0],) and all(len({m.traj_id for m in s}) == len(s) for s in sets)
    assert {frozenset(s) for s in sets} == {frozenset(x) for x in ([moves[0]], [moves[1]], [moves[2]], [moves[0], moves[1]], [moves[1], moves[2]])}
    out = baseline.emit([([0, 0], 5), ([0, 1], 3), ([1, 1], 1)], [2, 2], 20, 1.0)
    assert [c for _, c in out if c > 2][0] == 5 and [1, 1] != out[-1][0] or len(out) > 1
    assert baseline.emit([], [2], 5, 1.0) == []
    labels, centres = cluster.lloyd(__import__("numpy").array([[0.0], [0.1], [9.0], [9.1]]), 2, 1)
    assert labels[0] == labels[1] != labels[2] == labels[3]


def test_harness(spark, tmp_path):
    cfg = {"experiment_name": "x", "output_dir": str(tmp_path), "dataset": "d", "n_runs": 2, "dpapt": {"eps": [40.0], "tu": [1, 2]}, "adaptive_cells": {"c": [10.0], "f_m1": ["eps_sensitive"], "f_m2": ["eps_agnostic"], "n_clusters": [None], "do_filter": [True]}, "postprocess": {"sample": [False], "uniform": [False]}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(cfg))
    combos = harness.ExperimentConfig.read(str(path)).combinations()
    assert [c["id"] for c in combos] == [1, 2] and [c["tu"] for c in combos] == [1, 2]
    assert len(harness.BASELINE_COMBINATIONS) == 6
    with pytest.raises(FileNotFoundError):
        harness.main([str(tmp_path / "none.json")])
    none = lambda *a: spark.createDataFrame([], "pub_id string, t int, x double, y double, u double")
    stats, hd, qd = harness.run_once(toy(spark), BOX10, combos[0], 1, none)
    assert stats.first().hausdorff is None and stats.first().size_acc == 0 and hd.count() == qd.count() == 0


def test_sources_and_sinks(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.txt").write_text(f"{i},2008-02-02 15:36:08,116.51172,39.92123\n" * i)
    logs = readers.taxi_logs(spark, str(tmp_path / "*.txt"))
    assert logs.count() == 3 and logs.schema["ts"].dataType.typeName() == "timestamp"
    (tmp_path / "c.tsv").write_text("0\t2010-10-19T23:55:27Z\t30.2\t-97.7\t22847\n")
    c = readers.checkins(spark, str(tmp_path / "c.tsv")).first()
    assert c.user == "0" and c.location_id == 22847 and c.ts is not None
    df = spark.createDataFrame([(1, True, 2.0), (2, False, 3.0)], "a int, do_filter boolean, v double")
    readers.write(df, str(tmp_path / "r.csv"))
    assert readers.results(spark, str(tmp_path / "r.csv")).count() == 2
    readers.write(df, str(tmp_path / "r.parquet"), ["do_filter"])
    assert analysis.where_params(readers.results(spark, str(tmp_path / "r.parquet")), do_filter=True).count() == 1


def test_stream(spark, tmp_path):
    from wayveil.streaming import slots

    spark.createDataFrame([(1, dt.datetime(2008, 2, 2, 9, 1), 1.0, 1.0), (1, dt.datetime(2008, 2, 2, 9, 2), 1.0, 1.0), (1, dt.datetime(2008, 2, 2, 20, 0), 1.0, 1.0)], "id long, ts timestamp, lon double, lat double").write.parquet(str(tmp_path / "in"))
    s = slots.clean_stream(spark.readStream.schema("id long, ts timestamp, lon double, lat double").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("cleaned").count() == 1


def test_runs_draw_fresh_noise(spark):
    p = {"id": 1, "eps": 1.0, "tl": 0, "tu": 1}
    seeds = []

    def mech(points, box, p, seed):
        seeds.append(seed)
        return spark.createDataFrame([], "pub_id string, t int, x double, y double, u double")

    for run in (1, 1, 2):
        harness.run_once(toy(spark), BOX10, p, run, mech)
    harness.run_once(toy(spark), BOX10, p, 1, mech, seed="fixed")
    assert len(set(seeds[:3])) == 3 and min(map(len, seeds[:3])) == 64 and seeds[3] == "fixed"


def test_baseline_experiment(spark, tmp_path, monkeypatch):
    from wayveil.plans import cli

    points = readers.random_points(spark, 40, 16, BOX10, "b")
    points.select(F.col("traj_id").cast("string").alias("traj_id"), F.expr("timestamp_seconds(t * 600)").alias("ts"), F.lit("2008-02-02").cast("date").alias("date"), "x", "y").write.csv(str(tmp_path / "p.csv"), header=True)
    monkeypatch.setattr(harness, "BASELINE_COMBINATIONS", [{"id": 1, "ep": 2.0, "m": 3, "tl": 0, "tu": 3}])
    cli.main(["baseline", str(tmp_path / "p.csv"), str(tmp_path / "out"), "--runs", "2"])
    stats = spark.read.parquet(str(tmp_path / "out/stats.parquet")).collect()
    assert sorted(r.run for r in stats) == [1, 2] and {r.m for r in stats} == {3}
    qd = spark.read.parquet(str(tmp_path / "out/query_distortion.parquet"))
    assert {r.t_range for r in qd.select("t_range").distinct().collect()} <= {1, 2, 3, 4}


def test_emission_spends_filler_first():
    rows = [([0], 9), ([1], 2), ([2], 1)]
    out = baseline.emit(rows, [1000], 40, 0.3, "s")
    first = [c for _, c in out].index(9)
    assert first > 0 and all(2 <= c < 9 for _, c in out[:first]) and sum(c for _, c in out[:first]) <= 40
    assert baseline.emit(rows, [1000], 40, 0.3, "s") == out != baseline.emit(rows, [1000], 40, 0.3, "t")


def test_entries_that_clean(spark, tmp_path):
    from wayveil.plans import cli

    day = [dt.datetime(2008, 2, 2, 8, 30) + dt.timedelta(minutes=10 * k) for k in range(37)]
    for car, days in ((1, 2), (2, 1)):
        lines = [f"{car},{t + dt.timedelta(days=d)},{116.5 + 0.001 * (i % 9)},{39.9 + 0.001 * (i % 7)}" for d in range(days) for i, t in enumerate(day)]
        (tmp_path / f"{car}.txt").write_text("\n".join(lines) + "\n")
    cli.clean_logs(spark, str(tmp_path / "*.txt"), str(tmp_path / "points"), (1, 3))
    count = {n: readers.point_table(spark, str(tmp_path / f"points/{n}.csv")).count() for n in (1, 3)}
    assert count == {1: 74, 3: 111}
    one = cli.one_trajectory(readers.point_table(spark, str(tmp_path / "points/3.csv")), "2_2008-02-02").collect()
    assert len(one) == 37 and [r.ts for r in one] == sorted(r.ts for r in one)
    (tmp_path / "c.tsv").write_text("".join(f"{u}\t2010-10-{d:02d}T10:00:00Z\t30.2\t-97.7\t{d}\n" for u, ds in ((1, (1, 2, 3, 4)), (2, (2, 3))) for d in ds))
    cli.write_streaks(spark, str(tmp_path / "c.tsv"), str(tmp_path / "streaks"), 2)
    assert readers.results(spark, str(tmp_path / "streaks/2.csv")).count() == 6


def test_nearest_by_blocks(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(4)
    a, b = rnd.normal(size=(90, 6)) * 1e4, rnd.normal(size=(70, 6)) * 1e4
    a[3] = b[5]
    a[4] = a[7]
    monkeypatch.setattr(metrics, "BLOCK_BYTES", 600)
    pub = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "idx long, vec array<double>")
    org = spark.createDataFrame([(v.tolist(),) for v in b], "vec array<double>")
    got = {r.idx: r.d for r in metrics.individual_hausdorff(pub, org).collect()}
    want = np.sqrt(((a[:, None] - b) ** 2).sum(2)).min(1)
    assert got.keys() == set(range(90)) and np.allclose([got[i] for i in range(90)], want, rtol=1e-12, atol=1e-9)
    assert metrics.individual_hausdorff(pub.limit(0), org).count() == metrics.individual_hausdorff(pub, org.limit(0)).count() == 0
