from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tapeline.functions import dates
from tapeline.functions.text import contains_any, normalise_here, normalise_text
from tapeline.operators import headlines


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_normalise(spark):
    texts = ["  S&P 500: Bubble, or Bargain?!  ", "AI/tech sell-off", None, "", "ＷＩＤＥ\u3000blank", "a—b_c", "$5 + ^x | ~<", "Ａ\xa0b", "..."]
    want = ["sp 500 bubble or bargain", "ai tech sell off", "", "", "wide blank", "a b c", "$5 + ^x | ~<", "a b", ""]
    assert one(spark, normalise_text, *texts) == want
    assert [normalise_here(t or "") for t in texts] == want


def test_contains(spark):
    assert one(spark, lambda c: contains_any(c, ["correction", ""]), "corrections", "none", "") == [True, False, False]


def test_timestamps(spark):
    values = ["20240105213000", "20240105195900", "2024-01-05", "20240105", "2024-01-05T21:30:00Z", "2024-01-05 21:30:00+02:00", "20240105T213000", "2024", "T12:00:00", "20241305000000", "2024-01-05T24:00:00", None, " ", "2024-01-05T21:30:00.25Z", "20240714T170809+05:30", "2024-01-05T10"]
    got = [None if v is None else str(v) for v in one(spark, dates.utc_timestamp, *values)]
    assert got == ["2024-01-05 21:30:00", "2024-01-05 19:59:00", None, None, "2024-01-05 21:30:00", "2024-01-05 19:30:00", "2024-01-05 21:30:00", None, None, None, None, None, None, "2024-01-05 21:30:00.250000", "2024-07-14 11:38:09", "2024-01-05 10:00:00"]
    assert one(spark, lambda c: dates.flexible_day(c).cast("string"), "2024-01-05", "20240105", "2024-01-05T23:00:00Z", "1/5/2024", "2024-02-30", None) == ["2024-01-05", "2024-01-05", "2024-01-05", None, None, None]


def heads(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, domain string, seendate string")


def test_cleaning_and_calendar(spark):
    df = heads(spark, [(1, "A b", "x", "20240105213000"), (2, "A b", "x", "20240105195900"), (3, None, None, None), (4, "q", "x", "20240105210000")]).withColumn("trading_day", F.lit("old"))
    got = {r.id: r for r in headlines.clean_headlines(df).collect()}
    assert (got[1].seendate_ny, got[1].published_date_ny, got[1].trading_day) == ("2024-01-05T16:30:00-05:00", "2024-01-05", "2024-01-08")
    assert got[2].trading_day == got[4].trading_day == "2024-01-05"
    assert (got[3].normalised_title, got[3].seendate_ny, got[3].trading_day) == ("", "", "")
    calendar = spark.createDataFrame([("2024-01-05",), ("2024-01-09",), ("2024-01-05",)], "date string")
    assert {r.id: r.trading_day for r in headlines.clean_headlines(df, calendar).collect()}[1] == "2024-01-09"
    early = heads(spark, [(1, "a", "x", "20240101000000")])
    assert headlines.uncovered_days(early, calendar).count() == 1
    with pytest.raises(headlines.CoverageError, match="2024-01-01"):
        headlines.clean_headlines(early, calendar, strict=True)
    assert headlines.clean_headlines(df.limit(0), calendar).count() == 0


def test_exact_and_fuzzy(spark):
    t = "the market is looking very expensive after a long run in chip stocks"
    df = heads(spark, [(1, t, "X", "20240105195900"), (2, t.upper(), " x ", "20240105195901"), (3, t + "!", "y", "20240105195901"), (4, t + " s", "x", "20240105195900"), (5, t, "x", "20240106195900"), (6, "other words altogether here", "x", "20240105195900")])
    clean = headlines.clean_headlines(df)
    assert sorted(r.id for r in headlines.dedupe_exact(clean, "id").collect()) == [1, 3, 4, 5, 6]
    assert sorted(r.id for r in headlines.dedupe_fuzzy(clean, "id").collect()) == [1, 3, 5, 6]
    assert sorted(r.id for r in headlines.dedupe_fuzzy(clean, "id", 1.0).collect()) == [1, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        headlines.dedupe_fuzzy(clean, "id", 1.5)


def test_fuzzy_agrees_with_brute_force(spark, sf):
    clean = headlines.clean_headlines(spark.read.parquet(f"{sf}/headlines.parquet")).filter("headline_id is not null")
    got = {r[0] for r in headlines.dedupe_fuzzy(clean, "headline_id").select("headline_id").collect()}
    rows = sorted(headlines.dedupe_exact(clean, "headline_id").select("headline_id", headlines.dedupe_day(clean.columns).alias("d"), F.lower(F.coalesce(F.trim("domain"), F.lit(""))).alias("m"), "normalised_title").collect())
    kept: dict = {}
    for i, d, m, title in rows:
        if not any(SequenceMatcher(None, title, k).ratio() >= 0.96 for _, k in kept.get((d, m), [])):
            kept.setdefault((d, m), []).append((i, title))
    assert got == {i for v in kept.values() for i, _ in v}


def test_payload(spark, tmp_path):
    import json

    article = lambda **k: {"title": "A", "url": "u", "domain": "d.com", "language": "English", "seendate": "s"} | k
    payload = {"query_type": "q", "source_language": "english", "responses": [
        {"date": "2024-01-01", "query": "q", "response": {"articles": [article(), article(title="a ", url="v"), article(title="B", language="French"), article(title="C", language=""), article(title="", url="u1"), article(title=None, url="U1", url_mobile="m"), article(title="D", source="", sourceName="N"), article(title="E", url="", url_mobile="m")]}},
        {"date": "2024-01-02", "query": "q", "response": {"articles": [article()]}}, {"date": "2024-01-03", "query": "q", "response": {}}, None,
    ]}
    (tmp_path / "p.json").write_text(json.dumps(payload))
    rows = [tuple(r) for r in headlines.flatten_payload(spark.read.schema(headlines.PAYLOAD).option("multiLine", True).json(str(tmp_path / "p.json")), "t").collect()]
    assert [(r[0], r[1], r[3]) for r in rows] == [("A", "u", "d.com"), ("C", "u", "d.com"), ("", "u1", "d.com"), ("D", "u", "N"), ("E", "m", "d.com"), ("A", "u", "d.com")]
    assert {r[6] for r in rows} == {"t"}


def test_deliveries(spark):
    df = spark.createDataFrame([(1, "q", "d", '{"title":"A","domain":"x"}'), (2, "q", "d", '{"domain":" X ","title":"a!"}'), (3, "q", None, "{broken"), (4, "q", "d", None), (5, "q", "e", '{"title":"A","domain":"x","language":"German"}')], "raw_id long, query_type string, date string, payload string")
    got = headlines.flatten_deliveries(df)
    assert sorted(r.raw_id for r in got.filter("title != ''").collect()) == [1]
    assert sorted(r.raw_id for r in headlines.flatten_deliveries(df, "german").filter("title != ''").collect()) == [1, 5]
