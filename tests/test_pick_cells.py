"""Sampled cells: what is drawn for every cell of an area is not shuffled."""

import pytest

from wayveil.operators import grid as G


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_draws_stay_where_they_are_made(spark, monkeypatch, few):
    """300 rows draw from 2,000 cells each; some cells, and all of one area, weigh nothing."""
    monkeypatch.setattr(G, "BROADCAST_CELLS", few)
    cells = spark.range(4_000).selectExpr("0 as t", "cast(id % 2 as int) as area_id", "cast(id as int) as cell_id", "case when id % 2 = 1 then 0.0 else double(id % 3) end as cnt")
    rows = spark.range(300).selectExpr("'p' || id as pub_id", "0 as t", "cast(id % 2 as int) as area_id")
    out = G.pick_cells(rows, cells, "z", "pub_id").collect()
    assert len(out) == 300 and all(r.cell_id % 2 == r.area_id and (r.area_id == 1 or r.cnt > 0) for r in out)
    assert len({r.cell_id for r in out}) > 200
    plan = G.pick_cells(rows, cells, "z", "pub_id")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Window" in line and "pub_id" in line]  # a window would shuffle, sort and hold all draws
