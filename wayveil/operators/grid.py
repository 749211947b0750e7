"""Two-level adaptive noisy grids over all time steps at once."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import noise

Bounds = tuple[float, float, float, float]


def m1_eps_sensitive(n: float, eps: float, c: float) -> int:
    return max(10, int(0.25 * math.ceil(math.sqrt(n * eps / c))))


def m1_eps_agnostic(n: float, eps: float, c: float) -> int:
    return max(5, int(0.25 * math.ceil(math.sqrt(n / c))))


def m2_eps_sensitive(nc: Column, eps2: float, c: float) -> Column:
    return F.ceil(F.sqrt(F.greatest(F.lit(1.0), nc * eps2) / (c / 2))).cast("int")


def m2_eps_agnostic(nc: Column, eps2: float, c: float) -> Column:
    return F.ceil(F.sqrt(F.greatest(F.lit(1.0), nc) / (c / 2))).cast("int")


M1 = {"eps_sensitive": m1_eps_sensitive, "eps_agnostic": m1_eps_agnostic}
M2 = {"eps_sensitive": m2_eps_sensitive, "eps_agnostic": m2_eps_agnostic}


def policy(table: dict, name: str) -> Callable:
    if name not in table:
        raise ValueError(f"unknown resolution policy {name!r}; known: {sorted(table)}")
    return table[name]


#: Cells, as rows of four numbers, up to which they are broadcast.
BROADCAST_CELLS = 1_000_000


@dataclass(frozen=True)
class GridConfig:
    eps: float
    c: float = 10.0
    beta: float = 0.5
    gamma: float = 0.1
    f_m1: str = "eps_sensitive"
    f_m2: str = "eps_sensitive"
    randomize: bool = True
    do_filter: bool = True
    seed: str = "s"
    leaf_divisor: str = "m2"  # or "m2sq": then leaves add up to the inferred root
    n_clusters: int | None = None
    lloyd_steps: int = 300  # at most; fewer if clusters are stable before

    @property
    def eps_n(self) -> float:
        return self.gamma * self.eps

    @property
    def eps1(self) -> float:
        return self.beta * (1 - self.gamma) * self.eps

    @property
    def eps2(self) -> float:
        return (1 - self.beta) * (1 - self.gamma) * self.eps

    @property
    def threshold(self) -> float:
        return 2 * math.sqrt(2) / self.eps if self.randomize and self.do_filter else 1.0

    def with_eps(self, eps: float) -> GridConfig:
        return replace(self, eps=eps)


def collect_bounds(points: DataFrame, pad: float = 0.01) -> Bounds:
    from .etl import bounds

    r = bounds(points, pad).first()
    return (r.xl, r.xu, r.yl, r.yu)


def resolutions(points: DataFrame, box: Bounds, cfg: GridConfig) -> DataFrame:
    """t, n (noisy, at least 1), m1, sx, sy: one row a step. The one action the grid needs."""
    per = points.groupBy("t").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if cfg.randomize:
        per = per.withColumn("n", F.greatest(F.lit(1.0), F.col("n") + noise.laplace(cfg.eps_n, cfg.seed, F.lit("n"), "t")))
    f, (xl, xu, yl, yu) = policy(M1, cfg.f_m1), box
    rows = [(r.t, r.n, f(r.n, cfg.eps, cfg.c)) for r in per.orderBy("t").collect()]
    cols = list(zip(*[(t, n, m, (xu - xl) / m, (yu - yl) / m) for t, n, m in rows])) or [[]] * 5
    return points.sparkSession.createDataFrame(pa.table(dict(zip(("t", "n", "m1", "sx", "sy"), (pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64())))))))


def locate_l1(points: DataFrame, res: DataFrame, box: Bounds) -> DataFrame:
    """Points with (i1, j1); those outside the bounds are dropped (see :func:`rejected`)."""
    xl, xu, yl, yu = box
    inside = (F.col("x") >= xl) & (F.col("x") < xu) & (F.col("y") >= yl) & (F.col("y") < yu)
    at = points.where(inside).join(F.broadcast(res), "t")  # one row a step
    return at.withColumn("i1", F.floor((F.col("x") - xl) / F.col("sx")).cast("int")).withColumn("j1", F.floor((F.col("y") - yl) / F.col("sy")).cast("int"))


def rejected(points: DataFrame, box: Bounds) -> DataFrame:
    xl, xu, yl, yu = box
    return points.where(~((F.col("x") >= xl) & (F.col("x") < xu) & (F.col("y") >= yl) & (F.col("y") < yu)))


def l1_cells(located: DataFrame, res: DataFrame, cfg: GridConfig) -> DataFrame:
    """t, i1, j1, n1 of every cell, empty ones too: they must get noise."""
    counts = located.groupBy("t", "i1", "j1").agg(F.count(F.lit(1)).alias("cnt"))
    dense = res.withColumn("i1", F.explode(F.sequence(F.lit(0), F.col("m1") - 1))).withColumn("j1", F.explode(F.sequence(F.lit(0), F.col("m1") - 1)))
    n1 = F.coalesce("cnt", F.lit(0)).cast("double")
    if cfg.randomize:
        n1 = n1 + noise.laplace(cfg.eps1, cfg.seed, F.lit("l1"), "t", "i1", "j1")
    return dense.join(counts, ["t", "i1", "j1"], "left").withColumn("n1", n1).drop("cnt", "n").withColumn("m2", policy(M2, cfg.f_m2)(F.col("n1"), cfg.eps2, cfg.c))


def locate_l2(located: DataFrame, l1: DataFrame, box: Bounds) -> DataFrame:
    at = located.join(l1.select("t", "i1", "j1", "m2"), ["t", "i1", "j1"])
    i2 = F.floor((F.col("x") - (box[0] + F.col("i1") * F.col("sx"))) / (F.col("sx") / F.col("m2"))).cast("int")
    j2 = F.floor((F.col("y") - (box[2] + F.col("j1") * F.col("sy"))) / (F.col("sy") / F.col("m2"))).cast("int")
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col("m2") - 1, c))
    return at.withColumn("i2", clamp(i2)).withColumn("j2", clamp(j2))


def leaves(l1: DataFrame, box: Bounds) -> DataFrame:
    sub = F.sequence(F.lit(0), F.col("m2") - 1)
    out = l1.withColumn("i2", F.explode(sub)).withColumn("j2", F.explode(sub))
    wx, wy = F.col("sx") / F.col("m2"), F.col("sy") / F.col("m2")
    x0, y0 = box[0] + F.col("i1") * F.col("sx") + F.col("i2") * wx, box[2] + F.col("j1") * F.col("sy") + F.col("j2") * wy
    return out.withColumns({"xl": x0, "xu": x0 + wx, "yl": y0, "yu": y0 + wy})


_LEAF = ["t", "i1", "j1", "i2", "j2"]


def l2_cells(located: DataFrame, l1: DataFrame, box: Bounds, cfg: GridConfig) -> DataFrame:
    counts = locate_l2(located, l1, box).groupBy(*_LEAF).agg(F.count(F.lit(1)).alias("cnt"))
    n2 = F.coalesce("cnt", F.lit(0)).cast("double")
    if cfg.randomize:
        n2 = n2 + noise.laplace(cfg.eps2, cfg.seed, F.lit("l2"), *_LEAF)
    return leaves(l1, box).join(counts, _LEAF, "left").withColumn("n2", n2).drop("cnt")


def infer(l2: DataFrame, cfg: GridConfig) -> DataFrame:
    """Leaf counts made consistent with their root: ``cnt``."""
    b2, a2 = cfg.beta**2, (1 - cfg.beta) ** 2
    m2 = F.col("m2").cast("double")
    total = F.sum("n2").over(Window.partitionBy("t", "i1", "j1"))
    root = b2 * m2 * m2 / (b2 * m2 * m2 + a2) * F.col("n1") + a2 / (b2 * m2 * m2 + a2) * F.col("S")
    divisor = m2 if cfg.leaf_divisor == "m2" else m2 * m2
    return l2.withColumn("S", total).withColumn("cnt", F.col("n2") + (root - F.col("S")) / divisor)


def cells(inferred: DataFrame, cfg: GridConfig) -> DataFrame:
    """Cells that stay, numbered row-major within their step, with centres."""
    kept = inferred.where(F.col("cnt") >= cfg.threshold) if cfg.do_filter else inferred
    number = F.row_number().over(Window.partitionBy("t").orderBy("i1", "j1", "i2", "j2")) - 1
    return kept.withColumn("cell_id", number.cast("int")).withColumns({"cx": (F.col("xl") + F.col("xu")) / 2, "cy": (F.col("yl") + F.col("yu")) / 2})


@dataclass
class Grid:
    """cells: with area_id; areas: t, area_id, cx, cy, cnt; assigned: traj_id, t, area_id."""

    cells: DataFrame
    areas: DataFrame
    assigned: DataFrame


def build(points: DataFrame, box: Bounds, cfg: GridConfig) -> Grid:
    """Grids of all steps in one plan; points find their area by arithmetic and an equi-join."""
    from .cluster import label_cells

    res = resolutions(points, box, cfg)
    located = locate_l1(points, res, box)
    l1 = l1_cells(located, res, cfg)
    kept = cells(infer(l2_cells(located, l1, box, cfg), cfg), cfg).persist()
    named = label_cells(kept, cfg) if cfg.n_clusters else kept.withColumn("area_id", F.col("cell_id")).withColumns({"ax": F.col("cx"), "ay": F.col("cy")})
    areas = named.groupBy("t", "area_id").agg(F.first("ax").alias("cx"), F.first("ay").alias("cy"), F.sum("cnt").alias("cnt"))
    assigned = locate_l2(located, l1, box).join(named.select(*_LEAF, "area_id"), _LEAF).select("traj_id", "t", "area_id")
    return Grid(named, areas, assigned)


def pick_cells(rows: DataFrame, named: DataFrame, seed: str, key: str) -> DataFrame:
    """``rows`` (key, t, area_id) and their cell: one of the area's, in proportion to max(count, 0); uniform if all are 0.

    Each row draws for every cell of its area; draws are compared where they are made and the best alone is kept.
    Cells are broadcast if they are few, counted first.
    """
    w = F.greatest(F.col("cnt"), F.lit(0.0))
    total = F.sum(w).over(Window.partitionBy("t", "area_id"))
    weighed = named.withColumn("_w", F.when(total > 0, w).otherwise(F.lit(1.0))).where("_w > 0").select("t", "area_id", "cell_id", F.ln("_w").alias("_w"))
    weighed = F.broadcast(weighed) if named.count() <= BROADCAST_CELLS else weighed
    # A number of partitions of its own: rows are so small that adaptive execution would put all draws in a few tasks.
    dealt = rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, key, "t")
    race = F.col("_w") + noise.gumbel(seed, F.lit("cell"), key, "t", "area_id", "cell_id")
    best = dealt.join(weighed, ["t", "area_id"]).groupBy(key, "t", "area_id").agg(F.max_by("cell_id", race).alias("cell_id"))
    return best.join(named, ["t", "area_id", "cell_id"])


def closest_cell(named: DataFrame) -> DataFrame:
    """The cell of each area nearest to the area's centre; the first of equals."""
    d = F.sqrt((F.col("cx") - F.col("ax")) ** 2 + (F.col("cy") - F.col("ay")) ** 2)
    return named.withColumn("_d", d).withColumn("_rn", F.row_number().over(Window.partitionBy("t", "area_id").orderBy("_d", "cell_id"))).where("_rn = 1").drop("_d", "_rn")
