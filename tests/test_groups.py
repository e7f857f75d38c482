"""Joins back from groups to rows, with a key that holds half of all rows."""

from pyspark.sql import functions as F

from tapeline.plans import groups


def test_attach(spark):
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 0, id) as k", "id")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = groups.attach(rows, counts, ["k"], "n")
    assert out.count() == 20_000 and out.filter("k = 0 and n = 10000").count() == 10_000
    assert groups.attach(rows.limit(0), counts.limit(0), ["k"], "n").count() == 0
    some = groups.attach(rows, counts.filter("k < 10"), ["k"], "n")
    assert some.count() == rows.filter("k < 10").count()
