"""Fits followed side by side are those of plain k-means, also where single precision can't tell centres apart; k-means runs few tasks a step."""

import numpy as np
import pytest

from wayveil.operators import baseline, cluster


@pytest.mark.parametrize(("n", "m", "offset"), [(700, 6, 0.0), (700, 6, 1e7), (300, 1, 0.0), (150, 9, 1e5)])
def test_fits_side_by_side(n, m, offset):
    x = np.random.default_rng(5).normal(size=(n, 6)) * 1e3 + offset
    drawn = np.sort(np.random.default_rng(1).choice(n - 1, m, replace=False))
    ids = [i for i in range(0, n, 2) if i <= drawn[0]] + [i for i in range(0, n, 2) if i > drawn[-1]]
    for start, rows in ((drawn + 1, [i for i in ids if i <= drawn[0]]), (drawn, [i for i in ids if i > drawn[-1]])):
        seen = set()
        for i, labels, centres in baseline._Run(x, x[start]).fits(rows):
            want, at = cluster.lloyd(np.delete(x, i, axis=0), m, 1)
            assert (np.delete(labels, i) == want).all() and np.allclose(centres, at, rtol=1e-12)
            seen.add(i)
        assert seen == set(rows)


def test_kmeans_takes_few_partitions(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(300)], "traj_id long, vec array<double>").repartition(60)
    cluster.kmeans(vectors, 3)
    assert seen == [spark.sparkContext.defaultParallelism]
