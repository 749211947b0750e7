"""Weighted k-means of grid cells, and plain k-means of flattened trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import noise

_EPS_WEIGHT = 0.01

#: Bytes of vectors that a task of k-means takes.
_FIT_BYTES = 32 << 20


def initial_centres(cells: DataFrame, k: int, seed: str) -> DataFrame:
    """t, area_id, ax, ay: min(k, cells) cells a step, without replacement, in proportion to clipped counts."""
    w = F.greatest(F.col("cnt"), F.lit(_EPS_WEIGHT))
    race = -F.ln(noise.uniform(seed, F.lit("init"), "t", "cell_id")) / w
    rank = F.row_number().over(Window.partitionBy("t").orderBy("_race", "cell_id"))
    return cells.withColumn("_race", race).withColumn("_k", rank).where(F.col("_k") <= k).select("t", (F.col("_k") - 1).alias("area_id"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))


def assign_cells(cells: DataFrame, centres: DataFrame) -> DataFrame:
    """Each cell with its nearest centre, the first of equals; a step's centres (k) are one broadcast row."""
    d = lambda c: (F.col("cx") - c["ax"]) ** 2 + (F.col("cy") - c["ay"]) ** 2
    near = F.array_min(F.transform("_each", lambda c: F.struct(d(c).alias("d"), c["area_id"].alias("area_id"), c["ax"].alias("ax"), c["ay"].alias("ay"))))
    each = centres.groupBy("t").agg(F.collect_list(F.struct("area_id", "ax", "ay")).alias("_each"))
    bare = cells.drop("area_id", "ax", "ay")
    return bare.join(F.broadcast(each), "t").withColumn("_near", near).select(*bare.columns, "_near.area_id", "_near.ax", "_near.ay")


def move_centres(assigned: DataFrame) -> DataFrame:
    w = F.greatest(F.col("cnt"), F.lit(_EPS_WEIGHT))
    return assigned.groupBy("t", "area_id").agg((F.sum(w * F.col("cx")) / F.sum(w)).alias("ax"), (F.sum(w * F.col("cy")) / F.sum(w)).alias("ay"))


def label_cells(cells: DataFrame, cfg) -> DataFrame:
    """Lloyd's steps from weighted initial centres until none moves; cells get area_id and the centre (ax, ay).

    ``cfg.lloyd_steps`` is the limit. Sums depend on their order in the last digits, so that much is no move.
    """
    spark, schema = cells.sparkSession, "t int, area_id int, ax double, ay double"
    listed = lambda df: [tuple(r) for r in df.select("t", "area_id", "ax", "ay").orderBy("t", "area_id").collect()]  # noqa: E731  k rows a step
    fixed = lambda rows: F.broadcast(spark.createDataFrame(rows, schema))
    still = lambda a, b: len(a) == len(b) and all(p[:2] == q[:2] and np.allclose(p[2:], q[2:], rtol=1e-10, atol=1e-9) for p, q in zip(a, b))
    rows = listed(initial_centres(cells, cfg.n_clusters, cfg.seed))
    for _ in range(cfg.lloyd_steps):
        before, rows = rows, listed(move_centres(assign_cells(cells, fixed(rows))))
        if still(before, rows):
            break
    return assign_cells(cells, fixed(rows))


def lloyd(x: np.ndarray, k: int, seed: int, iterations: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of a matrix that fits a task; ties go to the first centre, empty clusters stay put."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    labels = np.full(len(x), -1)
    for _ in range(iterations):
        new = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)  # squared distances, less what all centres share
        if (new == labels).all():
            break
        labels = new
        for j in range(len(centres)):
            if (labels == j).any():
                centres[j] = x[labels == j].mean(0)
    return labels, centres


def kmeans(vectors: DataFrame, k: int, seed: int = 1, key: str = "traj_id") -> tuple[DataFrame, DataFrame]:
    """(key, k) and (k, centre): distributed k-means of arrays. Each step is a job, so partitions are as few as cores and bytes allow."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = vectors.select(key, array_to_vector("vec").alias("features"))
    size = vectors.agg(F.coalesce(F.sum(8 * F.size("vec")), F.lit(0))).first()[0]
    model = KMeans(k=k, seed=seed, maxIter=300).fit(df.coalesce(max(vectors.sparkSession.sparkContext.defaultParallelism, -(-size // _FIT_BYTES))))
    centres = vectors.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "k int, centre array<double>")
    return model.transform(df).select(key, F.col("prediction").alias("k")), centres
