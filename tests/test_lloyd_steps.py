"""Clustering queries take the steps that their SQL takes."""

import re

import numpy as np
import pytest

from wayveil.operators import cluster
from wayveil.operators import grid as G
from wayveil.plans import queries

SMALL = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


def test_steps_are_those_of_the_sql(spark, monkeypatch):
    def build(points, box, cfg):
        raise Stop(cfg.lloyd_steps)

    monkeypatch.setattr(queries.G, "build", build)
    for name in ("cluster_areas_kmeans", "postprocess_clustered_closest_uniform", "postprocess_clustered_sampled_center", "postprocess_clustered_sampled_uniform"):
        with pytest.raises(Stop) as e:
            queries.QUERIES[name](spark, SMALL)
        assert e.value.args[0] == int(re.search(r"l\.step < (\d+)", queries.ORACLE[name])[1])


def test_a_limit_holds(spark):
    """Three steps, of the many that these cells need, against plain ones."""
    at = np.cumsum(np.linspace(0.1, 9.0, 80))
    cells = spark.createDataFrame([(0, i, float(x), 0.0, 1.0) for i, x in enumerate(at)], "t int, cell_id int, cx double, cy double, cnt double").persist()
    cfg = G.GridConfig(1.0, n_clusters=6, seed="k", lloyd_steps=3)
    want = np.array([r.ax for r in cluster.initial_centres(cells, 6, "k").orderBy("area_id").collect()])
    for _ in range(3):
        near = np.abs(at[:, None] - want).argmin(1)
        want = np.array([at[near == k].mean() for k in range(6)])
    got = {r.area_id: r.ax for r in cluster.label_cells(cells, cfg).select("area_id", "ax").distinct().collect()}
    assert np.allclose([got[k] for k in range(6)], want)
