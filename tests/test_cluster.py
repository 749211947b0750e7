"""Clustering of cells until it is stable."""

import numpy as np

from wayveil.operators import cluster
from wayveil.operators import grid as G


def test_clusters_are_stable(spark):
    """Cells ever farther apart: after ten steps the centres still move."""
    at = np.cumsum(np.linspace(0.1, 9.0, 80))
    cells = spark.createDataFrame([(0, i, float(x), 0.0, 1.0) for i, x in enumerate(at)], "t int, cell_id int, cx double, cy double, cnt double").persist()
    out = cluster.label_cells(cells, G.GridConfig(1.0, n_clusters=6, seed="k")).persist()
    now = {r.area_id: r.ax for r in out.select("area_id", "ax").distinct().collect()}
    then = {r.area_id: r.ax for r in cluster.move_centres(out).collect()}
    assert now.keys() == then.keys() and all(abs(now[k] - then[k]) < 1e-6 for k in now)
