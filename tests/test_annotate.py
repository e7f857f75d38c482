import random

import pytest

from tapeline.checks import CheckError
from tapeline.operators import annotate

COLUMNS = "id string, annotation_file string, query_type string, market_relevant_label string, criticism_label string, category_label string, intensity_score string, n long"


def source(spark, *titles, query="all_us_market", start=0):
    rows = [(i, t, "s", "d.com", "u", query, "2024-01-01") for i, t in enumerate(titles, start)]
    return spark.createDataFrame(rows, "n long, title string, source string, domain string, url string, query_type string, date string")


def test_strata(spark):
    pool = annotate.strata(source(spark, "Bubble?", "bubble"), source(spark, "bubble", "market corrections loom", "calm", "Calm!"), "n")
    assert sorted((r.stratum, r.n) for r in pool.collect()) == [("ambiguous", 1), ("general_market", 2), ("likely_criticism", 0)]
    rows, short = annotate.sample(pool, annotate.SampleSpec({"likely_criticism": 1, "general_market": 2, "ambiguous": 1}))
    got = rows.collect()
    assert [r.id for r in got] == ["ann_000001", "ann_000002", "ann_000003"]
    assert [r.sample_stratum for r in got] == ["likely_criticism", "general_market", "ambiguous"]
    assert short == {"likely_criticism": 0, "general_market": 1, "ambiguous": 0} and tuple(rows.columns) == annotate.ANNOTATION_COLUMNS
    with pytest.raises(CheckError):
        annotate.strata(source(spark, "a").drop("url"), source(spark, "a"), "n")
    with pytest.raises(CheckError, match="usable date"):
        annotate.strata(source(spark, "a").selectExpr("n", "title", "source", "domain", "url", "query_type", "'' as date"), source(spark, "a"), "n")


def test_draw_is_the_seeded_one(spark):
    titles = [f"title {i:03d}" for i in range(60)]
    pool = annotate.strata(source(spark), source(spark, *titles), "n")
    rows, _ = annotate.sample(pool, annotate.SampleSpec({"general_market": 10}, seed=3))
    assert [r.title for r in rows.collect()] == sorted(random.Random(3 + 47).sample(titles, 10))
    with pytest.raises(CheckError):
        annotate.draw_positions(5, -1, 1, 1)


def labels(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], COLUMNS)


def test_report(spark):
    df = labels(
        spark,
        ("1", "a", "candidate_criticism", "1", "1", "valuation", "2"), ("2", "a", "candidate_criticism", "1", "0", "valuation", ""), ("2", "a", "all_us_market", "", "1", "", "5"),
        ("3", "b", "all_us_market", "x", "?", "", "1d"), (None, "b", None, None, None, None, None),
    )
    r = annotate.validation_report(df, "n")
    assert (r["total_rows"], r["predicted_positive"], r["actual_positive"], r["true_positive"], r["false_positive"], r["false_negative"]) == (5, 2, 2, 1, 1, 1)
    assert r["label_precision"] == r["sample_recall"] == 0.5 and r["category_counts"] == {"valuation": 1} and r["intensity_distribution"] == {"2": 1, "5": 1}
    assert r["missing_labels"] == {"market_relevant_label": 2, "criticism_label": 1, "category_label": 1, "intensity_score": 0}
    assert r["invalid_labels"] == {"market_relevant_label": 1, "criticism_label": 1, "category_label": 0, "intensity_score": 2, "category_label_consistency": 1, "intensity_score_consistency": 1, "duplicate_id_within_file": 1}
    assert r["agreement"] is None and "Precision: 0.500" in annotate.format_report(r)
    assert "n/a" in annotate.format_report(annotate.validation_report(df.limit(0), "n"))


def test_kappa(spark):
    one = lambda i, f, y: (i, f, "q", "1", y, "", "")
    got = annotate.rater_pairs(labels(spark, one("1", "a", "1"), one("2", "a", "0"), one("1", "b", "1"), one("2", "b", "1"), one("1", "b", "0"), one("3", "b", "x")), "n").first()
    assert tuple(got) == (2, 0.5, 0.0)
    same = annotate.rater_pairs(labels(spark, one("1", "a", "1"), one("1", "b", "1")), "n").first()
    assert tuple(same) == (1, 1.0, 1.0)
