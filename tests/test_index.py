import pytest

from tapeline.checks import CheckError
from tapeline.operators import index


def rows(spark, *data):
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "n long, day string, title string, domain string, url string")


def test_counts_ratio_zscore(spark):
    market = rows(spark, *(("2024-01-0%d" % d, "t", "x", "") for d in (1, 2, 3, 3)))
    cand = index.match_labels(rows(spark, ("2024-01-02", "t", "x", ""), ("2024-01-03", "t", "x", ""), ("2024-01-03", "u", "x", ""), ("2024-02-01", "v", "x", "")), None, "n")
    got = index.daily_index(market, cand, 3).collect()
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("2024-01-01", 0, 1, 0.0), ("2024-01-02", 1, 1, 1.0), ("2024-01-03", 2, 2, 1.0)]
    assert [r[4] for r in got][:2] == [None, None] and got[2][4] == pytest.approx(0.577350269)
    flat = index.daily_index(market, cand.limit(0), 2).collect()
    assert all(r[4] is None for r in flat)
    with pytest.raises(CheckError, match="2024-01-02"):
        index.daily_index(market, cand.unionByName(cand), 3)
    with pytest.raises(CheckError):
        index.daily_index(market, cand, 0)
    assert index.daily_index(market.limit(0), cand, 3).count() == 0


def test_labels(spark):
    cand = rows(spark, ("2024-01-01", "A b", "x", "u1"), ("2024-01-01", "A-b", " X", "other"), ("2024-01-02", "c", "x", ""), ("2024-01-02", "d", "x", None))
    label = lambda *d: spark.createDataFrame(list(d), "day string, title string, domain string, url string, criticism_label string, category_label string")
    labels = label(("2024-01-09", "zz", "q", " u1 ", "1", "valuation"), ("2024-01-01", "a b", "x", "", "0", ""), ("2024-01-02", "C", "x", None, " 1", "made_up"))
    got = {r.n: (r.counts, r.category) for r in index.match_labels(cand, labels, "n").collect()}
    assert got == {0: (True, "valuation"), 1: (False, ""), 2: (True, ""), 3: (True, "")}
    with pytest.raises(CheckError, match="conflicting"):
        index.match_labels(cand, labels.unionByName(label(("2024-01-02", "c", "x", "", "0", ""))), "n")
    with pytest.raises(CheckError, match="not 0 or 1"):
        index.match_labels(cand, label(("2024-01-02", "c", "x", "", "maybe", "")), "n")
    assert index.match_labels(cand.limit(0), labels.unionByName(labels), "n").count() == 0
    out = index.daily_index(cand, index.match_labels(cand, labels, "n"), 2)
    assert "raw_criticism_count_valuation" in out.columns and "narrative_index_concentration" in out.columns
    assert [r.raw_criticism_count_valuation for r in out.collect()] == [1, 0]


def test_days(spark):
    df = spark.createDataFrame([(0, None, "20240102", "x"), (1, "2024-01-03", "2024-01-04", ""), (2, " ", None, "soon")], "n long, trading_day string, date string, published_date_ny string")
    assert [r.day for r in index.with_day(df).orderBy("n").collect()] == ["2024-01-02", "2024-01-03", None]
    assert [tuple(r) for r in index.undated(df, "n").collect()] == [(2, "soon")]
    with pytest.raises(CheckError, match="'soon'"):
        index.require_days(df, "n", "market")
    with pytest.raises(CheckError):
        index.with_day(df.select("n"))
