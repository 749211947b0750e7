"""Common shingles: offered ones go through one shuffle, which counting and joining read."""

from collections import Counter

from pyspark.sql import functions as F

from wayveil.llm import jaccard


def test_offered_shingles_are_shuffled_once(spark, tmp_path):
    spark.range(900).selectExpr("id as uid", "array(id % 700, 1000 + id, -1 - id % 5) as tok").write.parquet(str(tmp_path / "t"))
    table, reps, others = spark.read.parquet(str(tmp_path / "t")), spark.range(900).selectExpr("id as rid", "20L as n", "3L as low"), spark.range(10).selectExpr("id + 890 as uid")
    want = Counter(t for u in range(890) for t in (u % 700, 1000 + u, -1 - u % 5))
    plans, write = [], jaccard.written

    def seen(df, label, batch=None):
        if label == "jac-prefix":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return write(df, label, batch)

    jaccard.written = seen
    try:
        got = jaccard.region_members(table, reps, others, 80)
    finally:
        jaccard.written = write
    dealt = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(t#" in line]
    assert len(dealt) == 2 and sum("ReusedExchange" in line for line in dealt) == 1
    members = {(r.rid, r.t) for r in got.collect()}
    assert members and all(want[t] > 1 and t < 700 and rid < 890 for rid, t in members)


def test_counts(spark):
    rows = spark.range(1_000).select(F.col("id").alias("rid"), F.explode(F.array(F.col("id") % 9, F.col("id") + 50, F.col("id") % 600 - 600)).alias("t"))
    want = Counter(t for i in range(1_000) for t in (i % 9, i + 50, i % 600 - 600))
    got = jaccard._common(rows).collect()
    assert {r.t: r.df for r in got} == {t: c for t, c in want.items() if c > 1}
    assert Counter(r.t for r in got) == {t: c for t, c in want.items() if c > 1}
