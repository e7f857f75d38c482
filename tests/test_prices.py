import csv
import math

import pytest
from pyspark.sql import functions as F

from tapeline.checks import CheckError
from tapeline.operators import prices
from tapeline.plans import index_queries

DAYS = [f"2024-01-0{d}" for d in range(1, 6)]
SERIES = {"SPY": (100, 110, 105, 126, 126), "QQQ": (50, 55, 60, 66, 72), "RSP": (200, 198, 202, 210, 205), "VIX": (20, 22, 21, 25, 23)}


def table(spark, skip=()):
    rows = [(d, s, "1000" if s == "SPY" else str(p), str(p) if s == "SPY" else "900" if s == "VIX" else "") for s, ps in SERIES.items() for d, p in zip(DAYS, ps) if (d, s) not in skip]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, date string, symbol string, close string, adj_close string")


def index_of(spark, days=DAYS):
    return spark.createDataFrame([(d, 1) for d in days], "date string, raw_criticism_count long")


def test_panel(spark):
    got = prices.build_panel(index_of(spark, DAYS[:2]), prices.checked_prices(table(spark), "n"), horizons=(1, 2), vol_window=2).collect()
    a, b = got
    assert a.spy_fwd_log_return_1d == pytest.approx(math.log(1.1)) and b.spy_lag_log_return_1d == pytest.approx(math.log(1.1))
    assert a.spy_fwd_max_drawdown_2d == 0 and b.spy_fwd_max_drawdown_2d == pytest.approx(105 / 110 - 1)
    assert (a.vix_level, a.vix_fwd_change_1d) == (20, 2)
    r = [math.log(110 / 100), math.log(105 / 110)]
    assert a.spy_fwd_realized_vol_2d == pytest.approx(math.sqrt((r[0] ** 2 + r[1] ** 2) / 2) * math.sqrt(252))
    assert a.spy_realized_vol_2d is None and b.spy_realized_vol_2d is None
    names = list(got[0].asDict())
    assert names[2:4] == ["spy_fwd_log_return_1d", "spy_fwd_log_return_2d"] and names[-3:] == ["vix_level", "vix_fwd_change_1d", "vix_fwd_change_2d"]


def test_realised_volatility(spark):
    long = prices.long_features(prices.grid(prices.checked_prices(table(spark), "n")), (1,), 2)
    spy = [r for r in long.filter("symbol = 'SPY'").orderBy("date").collect()]
    r = [math.log(110 / 100), math.log(105 / 110)]
    sd = math.sqrt(sum((x - sum(r) / 2) ** 2 for x in r)) * math.sqrt(252)
    assert spy[2].realized_vol_2d == pytest.approx(sd) and spy[3].lag_realized_vol_2d == pytest.approx(sd)
    with pytest.raises(CheckError):
        prices.long_features(long, ())
    with pytest.raises(CheckError):
        prices.long_features(long, (1,), 1)


@pytest.mark.parametrize(("day", "symbol", "problem"), [(DAYS[1], "QQQ", "no_price"), (DAYS[2], "QQQ", "window"), (DAYS[2], "VIX", "window")])
def test_gaps(spark, day, symbol, problem):
    p = prices.checked_prices(table(spark, {(day, symbol)}), "n")
    gaps = prices.coverage_gaps(index_of(spark, [DAYS[1]]), prices.grid(p), horizons=(1,), vol_window=2).collect()
    assert [(g.symbol.lstrip("^"), g.problem) for g in gaps] == [(symbol, problem)]
    with pytest.raises(CheckError, match=problem):
        prices.build_panel(index_of(spark, [DAYS[1]]), p, horizons=(1,), vol_window=2)


def test_refusals(spark):
    p = table(spark)
    add = lambda *r: p.unionByName(spark.createDataFrame([(99, *r)], p.schema))
    assert prices.checked_prices(add(DAYS[0], "qqq ", "50.0", ""), "n").count() == 20
    for extra, what in (((DAYS[0], "QQQ", "51", ""), "conflicting"), ((DAYS[0], "QQQ", "-1", ""), "unusable"), ((DAYS[0], "QQQ", "x", ""), "unusable"), (("soon", "QQQ", "1", ""), "date"), ((DAYS[0], "QQQ", "inf", ""), "unusable")):
        with pytest.raises(CheckError, match=what):
            prices.checked_prices(add(*extra), "n")
    with pytest.raises(CheckError, match="RSP"):
        prices.checked_prices(p.filter("symbol != 'RSP'"), "n")
    with pytest.raises(CheckError, match="lacks columns"):
        prices.select_prices(p.drop("close"))
    ok = prices.checked_prices(p, "n")
    with pytest.raises(CheckError, match="more than once"):
        prices.build_panel(index_of(spark, [DAYS[0], DAYS[0]]), ok)
    with pytest.raises(CheckError, match="no_market_day"):
        prices.build_panel(index_of(spark, ["2023-01-01"]), ok)


def test_symbols():
    assert prices.canonical_symbols([" vix", "^VIX", "spy", "SPY", None]) == ("^VIX", "SPY", "")
    assert (prices.prefix_of("vix"), prices.prefix_of("Spy")) == ("vix", "spy")


LINES = [
    '"2024-01-02",SPY,1,1,1,"4.5","4.25","1,000"', '2024-01-02,"SPY","1,5",1,1,4.5,4.75,7', '2024-01-02,SPY,1,1,1,4.5,4.25,"1,000"\r', '2024-01-02,"QQQ",6"1,1,1,"3.5",,7',
    '2024-01-02,"Q""Q",1,"",1,3.5,,"approx ""1m"""', '2024-01-03,QQQ,1,"6"1z,1,3.5,', '2024-01-03,QQQ,1,"61,1,3.5,,7', '""', '', ',', '"', '"",""', 'a,"b"",c', 'плата,"a,б"',
]


def read(line):
    """Python's own reader; a carriage return that ends the line stays with its field."""
    return None if line is None else [x.replace("~", "\r") for x in next(csv.reader([line.replace("\r", "~")]))] or [""]


def test_csv_fields(spark):
    rows = [*LINES, None, '"' + 'ab""' * 20_000 + '",x']
    df = spark.createDataFrame(list(enumerate(rows)), "line_id long, line string")
    got = dict(df.select("line_id", prices.csv_fields(F.col("line"))).collect())
    assert [got[i] for i in range(len(rows))] == [read(x) for x in rows]


def test_quoted_lines(spark, tmp_path):
    spark.createDataFrame(list(enumerate(LINES)), "line_id long, line string").write.parquet(f"{tmp_path}/raw_price_lines.parquet")
    got = {r.line_id: (r.date, r.symbol, r.price) for r in index_queries.selected_prices(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(4)] == [("2024-01-02", "SPY", 4.25), ("2024-01-02", "SPY", 4.75), ("2024-01-02", "SPY", 4.25), ("2024-01-02", "QQQ", 3.5)]
    assert [tuple(r) for r in index_queries.price_conflicts(spark, str(tmp_path)).collect()] == [("2024-01-02", "SPY", 2)]
