import os

import pytest
from pyspark.sql import functions as F

from tapeline.llm import mixing

SCHEMA = "mix_id string, source string, target_pct int, max_repeats int, budget_pct int"


def sizes_of(spark, counts):
    rows = [(n * 10_000 + i, s, 10 + (i * 7) % 50) for n, (s, c) in enumerate(counts.items()) for i in range(c)]
    return spark.createDataFrame(rows, "doc_id long, key string, tokens long")


def test_shares_and_gaps(spark):
    sizes = sizes_of(spark, {"big": 3000, "mid": 600, "small": 60})
    total = sizes.agg(F.sum("tokens")).first()[0]
    targets = spark.createDataFrame([("m", " Big", 50, 1, 40), ("m", "MID", 30, 3, 40), ("m", "small", 20, 2, 40), ("m", "none", 0, 1, 40)], SCHEMA)
    plan = mixing.plan_mixtures(sizes, targets)
    assert {tuple(r) for r in mixing.shortfalls(spark, plan).collect()} == {("m", "small")}
    mixture = mixing.mix(sizes, plan)
    assert mixture.groupBy("mix_id", "doc_id").count().filter("count > 1").count() == 0
    caps = {r[0]: r[1] for r in mixture.groupBy("source").agg(F.max("copies")).collect()}
    assert caps[" Big"] == 1 and caps["MID"] <= 3 and caps["small"] == 2
    got = {r.source: r.actual_pct for r in mixing.shares(mixture, plan).collect()}
    assert got[" Big"] == pytest.approx(50, abs=1.5) and got["MID"] == pytest.approx(30, abs=1.5) and got["small"] < 20 and got["none"] == 0
    assert mixture.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] < 0.4 * total


def test_exactly_met_is_met(spark):
    sizes = spark.createDataFrame([(1, "a", 50), (2, "b", 50)], "doc_id long, key string, tokens long")
    plan = mixing.plan_mixtures(sizes, spark.createDataFrame([("m", "a", 100, 2, 100), ("n", "a", 100, 1, 51)], SCHEMA))
    assert dict(zip(plan.mix_id, plan.met)) == {"m": True, "n": False}
    assert {(r.mix_id, r.doc_id): r.copies for r in mixing.mix(sizes, plan).collect()} == {("m", 1): 2, ("n", 1): 1}


@pytest.mark.skipif(not os.path.exists(os.path.join(mixing.TOKENIZERS, mixing.VOCABULARY)), reason="no vocabulary here")
def test_tokens_and_edges(spark):
    docs = spark.createDataFrame([(1, "Hello world", " A "), (2, None, "a"), (3, "", None), (4, "x" * 30_000, "B"), (5, "Hello world", "a")], "doc_id long, text string, source string").selectExpr("*", "1 as key", "2 as tokens")
    got = {r.doc_id: (r.key, r.tokens) for r in mixing.measured(docs).collect()}
    assert got[1] == ("a", 2) and got[2] == ("a", 0) and got[3] == ("", 0) and got[4][1] > 100
    empty = mixing.measured(docs.limit(0))
    plan = mixing.plan_mixtures(empty, spark.createDataFrame([("m", "a", 10, 1, 10)], SCHEMA))
    assert plan.met.tolist() == [True] and mixing.mix(empty, plan).count() == 0
