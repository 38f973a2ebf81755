"""Attempts of segments: the same as one by one, and not sorted."""

from pyspark.sql import functions as F

from chirplake.operators import groups
from chirplake.plans import queries as core


def test_first_with_its_columns(spark):
    keys = spark.range(50).withColumnRenamed("id", "k")
    value = (F.col("k") * 7 + F.col("attempt") * 5) % 11
    evaluate = lambda df: df.withColumn("value", value).withColumn("accepted", F.col("value") < 3).where("value <> 9")
    got = {r["k"]: (r["attempt"], r["value"]) for r in groups.first_accepted(keys, 3, evaluate, ["value"]).collect()}
    want = {}
    for k in range(50):
        tried = [(a, (k * 7 + a * 5) % 11) for a in range(3)]
        want[k] = next(((a, v) for a, v in tried if v < 3), (None, None))
    assert got == want and (None, None) in got.values()


def test_no_sort_of_attempts(spark, sf_dir):
    plan = core.QUERIES["segment_accept"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "min_by(" in plan
    assert "REPARTITION_BY_NUM" in plan[plan.index("Generate explode") :]  # keys are dealt before they become attempts
