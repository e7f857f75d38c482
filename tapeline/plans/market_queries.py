"""Registered queries of the pipeline on its own price lines, refusals as relations, and the SQL of the regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.config import HORIZONS, SYMBOLS, VIX
from tapeline.io import table
from tapeline.operators import headlines, index, prices
from tapeline.plans import events, regress
from tapeline.plans import index_queries as iq
from tapeline.session import cut_lineage


def market_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The first usable price of each day and symbol of the price lines."""
    return iq.rounded(prices.first_prices(iq._split_lines(spark, sf), "line_id"))


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    return prices.carried_forward(prices.grid(prices.first_prices(iq._split_lines(spark, sf), "line_id"), SYMBOLS))


def market_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the four symbols, gaps carried forward: the lines leave most days without a price of some symbol."""
    long = prices.long_features(prices.grid(_filled(spark, sf), SYMBOLS))
    return iq.rounded(long.select("symbol", "date", F.col("position").cast("long").alias("position"), "price", *prices.feature_names(), *(f"fwd_change_{h}d" for h in HORIZONS)), 4)


def _market_panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = iq._dated(spark, sf)
    counted = index.match_labels(rows.filter("is_candidate"), None, "candidate_id")
    series = cut_lineage(_filled(spark, sf))
    days = index.daily_index(rows, counted, categories=False, strict=False).join(series.select("date").distinct(), "date", "left_semi")
    return prices.build_panel(days, series, SYMBOLS, strict=False)


def market_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The narrative index of the candidates with the market features, on days with prices."""
    return iq.rounded(_market_panel(spark, sf), 4)


def market_event_study(spark: SparkSession, sf: str) -> DataFrame:
    return iq.rounded(events.event_study(cut_lineage(_market_panel(spark, sf)), iq.ZSCORE)).withColumn("relative_day", F.col("relative_day").cast("long"))


def market_regressions(spark: SparkSession, sf: str) -> DataFrame:
    return iq.rounded(regress.regressions(spark, cut_lineage(_market_panel(spark, sf)), iq.ZSCORE))


def market_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What the features of each index day lack in the price lines as they are."""
    grid = prices.grid(prices.first_prices(iq._split_lines(spark, sf), "line_id"), SYMBOLS)
    days = iq._dated(spark, sf).select(F.col("day").alias("date"))
    return prices.coverage_gaps(days, grid, SYMBOLS)


def missing_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Valid symbols without a usable price, month by month."""
    rows = iq._split_lines(spark, sf).filter("date is not null and price is not null").withColumn("month", F.substring("date", 1, 7))
    return prices.missing_symbols(rows, table(spark, sf, "price_symbols"), "month")


def unusable_prices(spark: SparkSession, sf: str) -> DataFrame:
    return prices.unusable_prices(iq._split_lines(spark, sf), "line_id").select("line_id", "text")


def repeated_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days that a series of one symbol would have more than once."""
    return prices.repeated_days(iq._split_lines(spark, sf).filter("symbol = 'SPY' and date is not null"))


def numerator_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which all counted rows are more than those of the candidate query."""
    rows = iq._dated(spark, sf)
    return index.numerator_violations(rows.filter("is_candidate"), index.match_labels(rows, None, "candidate_id"))


def flatten_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The articles of nested payloads: each delivery as a block with its article twice, a null article and a null block."""
    day = F.to_json(F.struct(F.coalesce("date", F.lit("")).alias("date")))
    text = F.concat(
        F.lit('{"source_language":"english","responses":[null,'), F.substring_index(day, "}", 1), F.lit(',"response":{"articles":['), F.col("payload"), F.lit(",null,"), F.col("payload"), F.lit("]}}]}")
    )
    rows = table(spark, sf, "raw_articles").select("raw_id", "query_type", F.from_json(text, headlines.PAYLOAD).alias("p"))
    payload = rows.select("raw_id", "query_type", "p.start_date", "p.end_date", "p.source_language", "p.responses")
    return headlines.flatten_payload(payload, order=["raw_id"], keep=["raw_id"])


def calendar_gaps_early(spark: SparkSession, sf: str) -> DataFrame:
    """Target days that a calendar of the first trading year alone does not reach."""
    calendar = table(spark, sf, "trading_calendar")
    first = calendar.filter(F.substring("date", 1, 4) == calendar.agg(F.substring(F.min("date"), 1, 4)).first()[0])
    return headlines.uncovered_days(table(spark, sf, "headlines"), first).select(F.col("target_date").cast("string").alias("target_date"), "n")


QUERIES = {q.__name__: q for q in (market_prices, market_features, market_panel, market_event_study, market_regressions, market_gaps, missing_symbols, unusable_prices, repeated_days, numerator_violations, flatten_payloads, calendar_gaps_early)}

# --- SQL ---------------------------------------------------------------------------------------------------

_REAL = f"""{iq._PRICE_LINES},
series as (select date, symbol, arg_min(price, line_id) as price from lines_ where date is not null and price is not null group by date, symbol)"""
_REAL_LONG = iq._long_sql(iq._grid_sql(_REAL, SYMBOLS, filled=True))
_REAL_INDEX = f"{iq._DATED}, cand as (select day, '' as category from rows_ where is_candidate), ix as (select * from (with {iq._index_sql('rows_', 'cand', 15)}))"
_REAL_PANEL = f"with {_REAL_LONG}, {iq._wide_sql(SYMBOLS)}, {_REAL_INDEX}, panel as (select * from ix join wide using (date))"
_FILLED_PANEL = f"with {iq._long_sql(iq._grid_sql(iq._SERIES, iq.PANEL_SYMBOLS, filled=True))}, {iq._wide_sql()}, {iq._ORDERS}, ix as (select * from (with {iq._index_sql('o', 'u', 15)})), panel as (select * from ix left join wide using (date))"


def _event_sql(panel: str) -> str:
    return iq.SQL["event_study"].replace(iq._PANEL, panel)


def _two_sided(t: str) -> str:
    """The normal two-sided p-value of a t value: one minus a series of positive terms for the error function."""
    x = f"(abs({t}) / sqrt(2.0))"
    term = f"exp(2 * n * ln(2.0) + (2 * n + 1) * ln({x}) - lgamma(2.0 * n + 2) + lgamma(n + 1.0) - {x} * {x})"
    return f"case when abs({t}) > 7 then 0.0 when {t} = 0 then 1.0 else 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(200), lambda n: {term})) end"


def _hac_sql(panel: str, z: str = iq.ZSCORE) -> str:
    """The regressions: cross products swept on every regressor, then lagged score products with Bartlett weights."""
    parts, out = [panel], []
    for h in HORIZONS:
        for model, dependent, regressors in regress.model_specs(h, z):
            name, k = f"{model}_{h}", len(regressors) + 1
            columns = [f"x{i}" for i in range(k)] + ["y"]
            holes = " and ".join(f"{c} is not null" for c in (dependent, *regressors))
            parts.append(f"d_{name} as (select row_number() over (order by date) as t, 1.0 as x0, {', '.join(f'{c} as x{i}' for i, c in enumerate(regressors, 1))}, {dependent} as y from panel where {holes})")
            parts.append(f"s0_{name} as (select count(*) as n, {', '.join(f'sum({a} * {b}) as a{i}_{j}' for i, a in enumerate(columns) for j, b in enumerate(columns))} from d_{name})")
            for p in range(k):  # the sweep operator
                cells = [
                    f"1 / a{p}_{p} as a{p}_{p}" if i == j == p else f"a{i}_{j} / a{p}_{p} as a{i}_{j}" if i == p else f"-a{i}_{j} / a{p}_{p} as a{i}_{j}" if j == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} as a{i}_{j}"
                    for i in range(k + 1) for j in range(k + 1)
                ]
                parts.append(f"s{p + 1}_{name} as (select n, {', '.join(cells)} from s{p}_{name})")
            error = "y - " + " - ".join(f"a{i}_{k} * x{i}" for i in range(k))
            parts.append(f"u_{name} as (select t, {', '.join(f'({error}) * x{i} as u{i}' for i in range(k))} from d_{name}, s{k}_{name})")
            lagged = ", ".join(f"sum(w * (a.u{i} * b.u{j} + case when a.t = b.t then 0 else b.u{i} * a.u{j} end)) as m{i}_{j}" for i in range(k) for j in range(k))
            parts.append(f"m_{name} as (select {lagged} from (select a.t as ta, b.t as tb, 1 - (a.t - b.t) / {h}.0 as w from u_{name} a join u_{name} b on b.t between a.t - {h - 1} and a.t) p join u_{name} a on a.t = ta join u_{name} b on b.t = tb)")
            for i, term in enumerate(["const", *regressors]):
                variance = " + ".join(f"a{i}_{j} * m{j}_{l} * a{l}_{i}" for j in range(k) for l in range(k))
                out.append(f"select '{model}' as model, {h} as horizon, '{dependent}' as dependent, '{term}' as term, a{i}_{k} as b, sqrt({variance}) as e, n, {h - 1} as maxlags, '{dependent} ~ {' + '.join(regressors)}' as formula from s{k}_{name}, m_{name}")
    d = iq.DIGITS
    return f"""{', '.join(parts)}, fits as ({' union all '.join(out)}), tests as (select *, b / e as v from fits)
select model, horizon, dependent, term, round(b, {d}) + 0.0 as coefficient, round(e, {d}) as std_error, round(v, {d}) + 0.0 as t_value, round({_two_sided('v')}, {d}) + 0.0 as p_value, n, maxlags, formula from tests"""


def _panel_columns(symbols: tuple[str, ...]) -> str:
    return ", ".join(f"round({c}, 4) as {c}" for c in (iq.INDEX, iq.ZSCORE, *iq._wide_names(symbols)))


def _real_gaps() -> str:
    sql = iq._gap_sql().replace(iq._GRID, iq._grid_sql(_REAL, SYMBOLS))
    return sql.replace("days as (select distinct strftime(o_orderdate, '%Y-%m-%d') as date from orders)", f"{iq._DATED}, days as (select distinct day as date from rows_)")


SQL = {
    "market_prices": f"with {_REAL} select date, symbol, round(price, {iq.DIGITS}) as price from series",
    "market_features": f"with {_REAL_LONG} select symbol, date, position, " + ", ".join(f"round({c}, 4) as {c}" for c in ("price", *prices.feature_names(), *(f"fwd_change_{h}d" for h in HORIZONS))) + " from long_",
    "market_panel": f"{_REAL_PANEL} select date, raw_criticism_count, total_market_article_count, {_panel_columns(SYMBOLS)} from panel",
    "market_event_study": _event_sql(_REAL_PANEL),
    "market_regressions": _hac_sql(_REAL_PANEL),
    "ols_hac": _hac_sql(_FILLED_PANEL),
    "market_gaps": _real_gaps(),
    "missing_symbols": f"""with {iq._PRICE_LINES}, seen as (select distinct substr(date, 1, 7) as month, symbol from lines_ where date is not null and price is not null),
wanted as (select distinct case when upper({iq._strip('symbol')}) in ('VIX', '{VIX}') then '{VIX}' else upper({iq._strip('symbol')}) end as symbol from price_symbols)
select month, symbol from (select distinct month from seen) cross join wanted where symbol != '' and (month, symbol) not in (select (month, symbol) from seen)""",
    "unusable_prices": f"with {iq._PRICE_LINES} select line_id, text from numbers_ where not coalesce(x > 0 and x < 'infinity'::double, false)",
    "repeated_days": f"with {iq._PRICE_LINES} select date, count(*) as n from lines_ where symbol = 'SPY' and date is not null group by date having count(*) > 1",
    "numerator_violations": f"""with {iq._DATED}, k as (select day, count(*) as candidates, count(*) filter (where is_candidate) as market from rows_ group by day)
select day, candidates, market from k where market > 0 and candidates > market""",
    "flatten_payloads": iq.SQL["flatten_articles"],
    "calendar_gaps_early": iq.SQL["calendar_gaps"].replace("from trading_calendar)", "from trading_calendar where date[:4] = (select min(date)[:4] from trading_calendar))"),
}
