"""Registered queries of the narrative-index pipeline, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.config import ALL_MARKET, CANDIDATE, CATEGORIES, CRITICISM_TERMS, END_DATE, ETFS, HORIZONS, START_DATE, VIX, VOL_WINDOW
from tapeline.functions import dates
from tapeline.functions.text import contains_any, normalise_here, normalise_text
from tapeline.io import table, under
from tapeline.operators import annotate, headlines, index, prices
from tapeline.plans import events, regress
from tapeline.session import checkpoint_dir, cut_lineage
from tapeline.sources import news
from tapeline.streaming import daily

INDEX = "narrative_index"
ZSCORE = f"{INDEX}_rolling_60d_zscore"
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that two engines' last bits don't matter; no negative zeros."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


# --- headlines ---------------------------------------------------------------------------------------------


def normalise_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "headlines").select("headline_id", normalise_text(F.col("title")).alias("normalised_title"))


def _clean(spark: SparkSession, sf: str, calendar: bool = False) -> DataFrame:
    return headlines.clean_headlines(table(spark, sf, "headlines"), table(spark, sf, "trading_calendar") if calendar else None)


def ny_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf).select("headline_id", "seendate_ny", "published_date_ny")


def trading_days(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf).select("headline_id", "trading_day")


def calendar_asof(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf, calendar=True).select("headline_id", "trading_day")


def calendar_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return headlines.uncovered_days(table(spark, sf, "headlines"), table(spark, sf, "trading_calendar")).select(F.col("target_date").cast("string").alias("target_date"), "n")


def flatten_articles(spark: SparkSession, sf: str) -> DataFrame:
    return headlines.flatten_deliveries(table(spark, sf, "raw_articles")).select("raw_id", "title", "url", "domain", "source", "seendate", "language", "query_type")


def dedupe_exact(spark: SparkSession, sf: str) -> DataFrame:
    return headlines.dedupe_exact(_clean(spark, sf), "headline_id").select("headline_id", "normalised_title", "published_date_ny", "trading_day")


def dedupe_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return headlines.dedupe_fuzzy(_clean(spark, sf), "headline_id").select("headline_id", "normalised_title")


# --- index -------------------------------------------------------------------------------------------------


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with their day and whether their headline came from the candidate query."""
    types = table(spark, sf, "headlines").filter(F.col("query_type") == CANDIDATE).select("headline_id").withColumn("is_candidate", F.lit(True))
    return index.with_day(table(spark, sf, "index_candidates")).join(types, "headline_id", "left").filter("day is not null")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return index.with_day(table(spark, sf, "annotation_labels").withColumn("normalised_title", F.lit("")))


def daily_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dated(spark, sf)
    counted = index.match_labels(rows.filter("is_candidate"), None, "candidate_id")
    return rounded(index.daily_index(rows, counted, categories=False, strict=False))


def undated_rows(spark: SparkSession, sf: str) -> DataFrame:
    return index.undated(table(spark, sf, "index_candidates"), "candidate_id")


def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return index.label_conflicts(_labels(spark, sf))


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return index.match_labels(_dated(spark, sf), _labels(spark, sf), "candidate_id", strict=False)


def label_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).select("candidate_id", "counts", "category")


def category_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dated(spark, sf)
    counted = index.match_labels(rows.filter("is_candidate"), _labels(spark, sf), "candidate_id", strict=False)
    return rounded(index.daily_index(rows, counted, categories=True, strict=False))


def order_index(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_order_index(spark, sf))


def _order_index(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    counted = orders.filter("o_orderpriority = '1-URGENT'").withColumns({"counts": F.lit(True), "category": F.lit("")})
    return index.daily_index(orders, counted, categories=False)


# --- prices and panel --------------------------------------------------------------------------------------

FLAGS = {"A": "SPY", "R": "QQQ", "N": VIX}
PANEL_SYMBOLS = tuple(FLAGS.values())


def _series(spark: SparkSession, sf: str) -> DataFrame:
    """Three price series with real gaps: the highest price of a day's lines by their flag."""
    rows = table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), "l_returnflag").agg(F.max("l_extendedprice").alias("price"))
    symbol = F.when(F.col("l_returnflag") == "A", "SPY").when(F.col("l_returnflag") == "R", "QQQ").otherwise(VIX)
    return rows.select("date", symbol.alias("symbol"), "price")


def price_features(spark: SparkSession, sf: str) -> DataFrame:
    long = prices.long_features(prices.grid(_series(spark, sf), PANEL_SYMBOLS))
    return rounded(long.drop("r").select("symbol", "date", F.col("position").cast("long").alias("position"), "price", *prices.feature_names(), *(f"fwd_change_{h}d" for h in HORIZONS)), 4)


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return prices.build_panel(_order_index(spark, sf), _series(spark, sf), PANEL_SYMBOLS, strict=False)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_panel(spark, sf), 4)


def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return prices.coverage_gaps(_order_index(spark, sf), prices.grid(_series(spark, sf), PANEL_SYMBOLS), PANEL_SYMBOLS)


def price_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return prices.price_conflicts(_split_lines(spark, sf).filter("date is not null and price is not null")).select("date", "symbol", "prices")


def _split_lines(spark: SparkSession, sf: str) -> DataFrame:
    part = prices.csv_fields(F.col("line"))
    rows = table(spark, sf, "raw_price_lines").select("line_id", *(F.get(part, i).alias(c) for i, c in enumerate(("date", "symbol", "open", "high", "low", "close", "adj_close", "volume"))))
    return prices.select_prices(rows, "line_id").withColumn("date", F.col("date").cast("string"))


def selected_prices(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_split_lines(spark, sf).select("line_id", "date", "symbol", "price"))


def _filled_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel on series whose gaps carry the last price forward: a complete row needs 22 days without one."""
    filled = prices.carried_forward(prices.grid(_series(spark, sf), PANEL_SYMBOLS))
    return prices.build_panel(_order_index(spark, sf), filled, PANEL_SYMBOLS, strict=False)


def event_study(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events.event_study(_panel(spark, sf), ZSCORE)).withColumn("relative_day", F.col("relative_day").cast("long"))


def ols_hac(spark: SparkSession, sf: str) -> DataFrame:
    """The nine regressions."""
    return rounded(regress.regressions(spark, cut_lineage(_filled_panel(spark, sf)), ZSCORE))


def ols_simple(spark: SparkSession, sf: str) -> DataFrame:
    f = regress.fit(cut_lineage(_panel(spark, sf)), "spy_fwd_log_return_1d", [ZSCORE], 0)
    return rounded(spark.createDataFrame([(f["terms"][i], float(f["coefficient"][i]), int(f["n"])) for i in range(2)], "term string, coefficient double, n bigint"))


# --- annotation --------------------------------------------------------------------------------------------


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    pool = table(spark, sf, "annotation_pool").dropDuplicates(["pool_id"])
    return annotate.strata(pool.filter(F.col("query_type") == CANDIDATE), pool, "pool_id", strict=False)


def keyword_strata(spark: SparkSession, sf: str) -> DataFrame:
    return _strata(spark, sf).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


def annotation_sample(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.sample(_strata(spark, sf))[0]


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(annotate.confusion(table(spark, sf, "annotation_labels")))


def category_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.label_histogram(table(spark, sf, "annotation_labels"), "category_label")


def intensity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.label_histogram(table(spark, sf, "annotation_labels"), "intensity_score")


def missing_labels(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.missing_labels(table(spark, sf, "annotation_labels"))


def invalid_labels(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.invalid_labels(table(spark, sf, "annotation_labels"))


def rater_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(annotate.rater_pairs(table(spark, sf, "annotation_labels"), "label_id"))


# --- collection --------------------------------------------------------------------------------------------


def _status(spark: SparkSession, sf: str) -> DataFrame:
    there = table(spark, sf, "raw_articles").select("query_type", dates.flexible_day(F.col("date")).alias("date")).filter("date is not null")
    return news.coverage(news.day_frame(spark, START_DATE, END_DATE), there, (ALL_MARKET, CANDIDATE))


def checkpoint_status(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf).withColumn("date", F.col("date").cast("string"))


def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return news.dry_run(_status(spark, sf), 10.0)


def archive_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(contains_any(F.lower("text"), [t.lower() for t in CRITICISM_TERMS])).select("doc_id")


def streaming_daily(spark: SparkSession, sf: str) -> DataFrame:
    counts = daily.daily_counts(daily.stream_table(spark, sf, "events"), "ts")
    folder = under(checkpoint_dir(spark), f"daily-{uuid.uuid4().hex}")
    daily.run_available(counts, under(folder, "counts"), under(folder, "state")).awaitTermination()
    return spark.read.schema("day date, n long").parquet(under(folder, "counts")).select(F.col("day").cast("string").alias("day"), "n")


QUERIES = {
    q.__name__: q
    for q in (
        daily_index, category_index, order_index, undated_rows, label_conflicts, label_match, normalise_titles, ny_timestamps, trading_days, calendar_asof, calendar_gaps,
        flatten_articles, dedupe_exact, dedupe_fuzzy, price_features, panel, coverage_gaps, price_conflicts, selected_prices, event_study, ols_hac, ols_simple,
        keyword_strata, annotation_sample, confusion, category_histogram, intensity_histogram, missing_labels, invalid_labels, rater_agreement,
        checkpoint_status, dry_run, archive_match, streaming_daily,
    )
}

# --- SQL ---------------------------------------------------------------------------------------------------

_WHITE = r"' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000\u00a0\u202f\u2007\u2009"
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''") + "     "


def _strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), {_WHITE})"


def _norm(x: str) -> str:
    flat = f"nfc_normalize(replace(replace(replace(translate(coalesce({x}, ''), '{_WIDE}', '{_NARROW}'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))"
    words = rf"regexp_replace(regexp_replace(lower({flat}), '[-‐‑‒–—―/\\_]', ' ', 'g'), '\p{{P}}', '', 'g')"
    return rf"trim(regexp_replace({words}, '\s+', ' ', 'g'))"


_ISO = r"^(?:\d{4}-\d{2}-\d{2}|\d{8})[T ](?:\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?$"


def _utc(text: str) -> str:
    """A timestamp in UTC from a stripped text column."""
    rest = rf"regexp_replace({text}, '^\d{{4}}-?\d{{2}}-?\d{{2}}[T ]', '')"
    g = lambda x, pattern, k=1: f"coalesce(nullif(regexp_extract({x}, '{pattern}', {k}), ''), '00')"
    day = rf"regexp_replace(regexp_extract({text}, '^\d{{4}}-?\d{{2}}-?\d{{2}}'), '-', '', 'g')"
    wall = f"try_strptime({day} || {g(rest, '^([0-9]{2})')} || {g(rest, '^[0-9]{2}:?([0-9]{2})')} || {g(rest, '^[0-9]{2}:?[0-9]{2}:?([0-9]{2})')}, '%Y%m%d%H%M%S')"
    micros = f"to_microseconds(cast(rpad(left({g(rest, '[.,]([0-9]+)')}, 6), 6, '0') as bigint))"
    zone = "([+-])([0-9]{2}):?([0-9]{2})?:?([0-9]{2})?$"
    offset = f"(case when regexp_extract({rest}, '{zone}', 1) = '-' then -1 else 1 end) * (3600 * cast({g(rest, zone, 2)} as bigint) + 60 * cast({g(rest, zone, 3)} as bigint) + cast({g(rest, zone, 4)} as bigint))"
    return f"case when regexp_full_match({text}, '\\d{{14}}') then try_strptime({text}, '%Y%m%d%H%M%S') when regexp_matches({text}, '{_ISO}') then {wall} + {micros} - to_seconds({offset}) end"


def _seen(body: str) -> str:
    """`body` over `seen`: headlines with utc, ny and target day."""
    return f"""with stripped as (select *, {_strip('seendate')} as t from headlines),
instants as (select *, {_utc('t')} as utc from stripped),
local as (select *, timezone('America/New_York', timezone('UTC', utc)) as ny from instants),
seen as (select *, cast(ny as date) + case when cast(ny as time) > time '16:00:00' then 1 else 0 end as target from local)
{body}"""


_WEEKDAY_ROLL = "target + case isodow(target) when 6 then 2 when 7 then 1 else 0 end"
_STAMP = """strftime(ny, '%Y-%m-%dT%H:%M:%S') || case when extract(microsecond from ny) % 1000000 != 0 then '.' || strftime(ny, '%f') else '' end
 || case when date_diff('minute', utc, ny) < 0 then '-' else '+' end || lpad(cast(abs(date_diff('minute', utc, ny)) // 60 as varchar), 2, '0') || ':' || lpad(cast(abs(date_diff('minute', utc, ny)) % 60 as varchar), 2, '0')"""


def _day_of(text: str) -> str:
    """flexible_day() as ISO text."""
    shaped = rf"(regexp_full_match({text}, '\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}}') or regexp_matches({text}, '{_ISO}'))"
    return rf"case when {shaped} then strftime(try_strptime(regexp_replace(regexp_extract({text}, '^\d{{4}}-?\d{{2}}-?\d{{2}}'), '-', '', 'g'), '%Y%m%d'), '%Y-%m-%d') end"


_CHOSEN = "coalesce(" + ", ".join(f"nullif({_strip(c)}, '')" for c in index.DATE_COLUMNS) + ")"
_DATED = f"""chosen as (select *, {_CHOSEN} as raw_day from index_candidates),
dated as (select c.*, {_day_of('raw_day')} as day, coalesce(h.query_type = '{CANDIDATE}', false) as is_candidate from chosen c left join headlines h using (headline_id)),
rows_ as (select * from dated where day is not null)"""


def _index_sql(market: str, counted: str, digits: int = DIGITS, categories: bool = False) -> str:
    """Daily index over relations `market` (day) and `counted` (day, category)."""
    extra = "".join(f", count(*) filter (where category = '{c}') as n_{c}" for c in CATEGORIES) if categories else ""
    columns = "".join(f", coalesce(n_{c}, 0) as raw_criticism_count_{c}, round(coalesce(n_{c}, 0) / total_market_article_count::double, {digits}) as {INDEX}_{c}" for c in CATEGORIES) if categories else ""
    return f"""m as (select day, count(*) as total_market_article_count from {market} group by day),
k as (select day, count(*) as n{extra} from {counted} group by day),
d as (select *, coalesce(n, 0) / total_market_article_count::double as v from m left join k using (day)),
z as (select *, count(v) over w as c, avg(v) over w as mean, stddev_samp(v) over w as sd, max(v) over w as hi, min(v) over w as lo from d window w as (order by day rows between 59 preceding and current row))
select day as date, coalesce(n, 0) as raw_criticism_count, total_market_article_count, round(v, {digits}) as {INDEX}, round(case when c = 60 and hi > lo then (v - mean) / sd end, {digits}) as {ZSCORE}{columns} from z"""


def _keyed(source: str, title: str) -> str:
    return f"select *, {_strip('url')} as u, coalesce(day, '') as kd, {_norm(title)} as kt, lower({_strip('domain')}) as kdom from {source}"


_LABELS = f"""chosen_l as (select *, coalesce(nullif({_strip('date')}, '')) as raw_l from annotation_labels),
dated_l as (select *, {_day_of('raw_l')} as day from chosen_l),
keyed_l as ({_keyed('dated_l', 'title')}),
values_l as (select u, kd, kt, kdom, case when {_strip('criticism_label')} in ('0', '1') then cast({_strip('criticism_label')} as int) else -1 end as y, {_strip('category_label')} as cat from keyed_l)"""
_TITLE = "coalesce(nullif(normalised_title, ''), title)"
_MATCHED = f"""{_LABELS},
by_url as (select u as bu, min(y) as uy, min(cat) as ucat from values_l where u != '' group by u having count(distinct (y, cat)) = 1),
by_key as (select kd as bd, kt as bt, kdom as bdom, min(y) as ky, min(cat) as kcat from values_l group by kd, kt, kdom having count(distinct (y, cat)) = 1),
keyed_c as ({_keyed('rows_', _TITLE)}),
met as (select c.*, coalesce(uy, ky) as y, case when uy is not null then ucat else kcat end as cat from keyed_c c left join by_url on nullif(c.u, '') = bu left join by_key on kd = bd and kt = bt and kdom = bdom),
labelled as (select *, (y is null or y != 0) as counts, case when y = 1 and cat in ({', '.join(repr(c) for c in CATEGORIES)}) then cat else '' end as category from met)"""

_FEATURES = ", ".join(
    [f"case when count(r) over p{VOL_WINDOW} = {VOL_WINDOW} then stddev_samp(r) over p{VOL_WINDOW} * sqrt(252.0) end as realized_vol_{VOL_WINDOW}d"]
    + [
        f"""ln(lead(price, {h}) over w / price) as fwd_log_return_{h}d, ln(price / lag(price, {h}) over w) as lag_log_return_{h}d,
case when count(r) over f{h} = {h} then sqrt(avg(r * r) over f{h}) * sqrt(252.0) end as fwd_realized_vol_{h}d,
case when price is not null and count(price) over f{h} = {h} then least(0.0, min(price) over f{h} / price - 1) end as fwd_max_drawdown_{h}d,
lead(price, {h}) over w - price as fwd_change_{h}d"""
        for h in HORIZONS
    ]
)
_WINDOWS = f"window w as (partition by symbol order by date), p{VOL_WINDOW} as (partition by symbol order by date rows between {VOL_WINDOW - 1} preceding and current row), " + ", ".join(f"f{h} as (partition by symbol order by date rows between 1 following and {h} following)" for h in HORIZONS)
_SERIES = f"""series as (select strftime(l_shipdate, '%Y-%m-%d') as date, case l_returnflag when 'A' then 'SPY' when 'R' then 'QQQ' else '{VIX}' end as symbol, max(l_extendedprice) as price from lineitem group by all)"""


def _grid_sql(series: str, symbols: tuple[str, ...] = PANEL_SYMBOLS, filled: bool = False) -> str:
    """`full_`: every symbol on every day of the relation `series`; `filled` carries the last price forward."""
    price = "last_value(price ignore nulls) over (partition by symbol order by date)" if filled else "price"
    return f"""{series},
axis as (select date, row_number() over (order by date) - 1 as position from (select distinct date from series)),
gappy as (select s.symbol, axis.date, position, price from axis cross join (values {', '.join(f"('{x}')" for x in symbols)}) s(symbol) left join series using (date, symbol)),
full_ as (select symbol, date, position, {price} as price from gappy)"""


_GRID = _grid_sql(_SERIES)


def _long_sql(grid: str) -> str:
    """`long_`: the features of each symbol and day over `full_`."""
    return f"""{grid},
returns as (select *, ln(price / lag(price) over (partition by symbol order by date)) as r from full_),
first_ as (select *, {_FEATURES} from returns {_WINDOWS}),
long_ as (select *, lag(realized_vol_{VOL_WINDOW}d) over (partition by symbol order by date) as lag_realized_vol_{VOL_WINDOW}d from first_)"""


_LONG = _long_sql(_GRID)
_ORDERS = """o as (select strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority from orders),
u as (select day, '' as category from o where o_orderpriority = '1-URGENT')"""


def _wide_names(symbols: tuple[str, ...] = PANEL_SYMBOLS) -> list[str]:
    return [f"{prices.prefix_of(s)}_{f}" for s in symbols if s in ETFS for f in prices.feature_names()] + ["vix_level", *(f"vix_fwd_change_{h}d" for h in HORIZONS)]


def _wide_sql(symbols: tuple[str, ...] = PANEL_SYMBOLS) -> str:
    """`wide`: one row per day of `long_`."""
    columns = [f"max({f}) filter (where symbol = '{s}') as {prices.prefix_of(s)}_{f}" for s in symbols if s in ETFS for f in prices.feature_names()]
    columns += [f"max(price) filter (where symbol = '{VIX}') as vix_level", *(f"max(fwd_change_{h}d) filter (where symbol = '{VIX}') as vix_fwd_change_{h}d" for h in HORIZONS)]
    return f"wide as (select date, {', '.join(columns)} from long_ group by date)"


_WIDE_NAMES = _wide_names()
_PANEL = f"""with {_LONG}, {_wide_sql()}, {_ORDERS},
ix as (select * from (with {_index_sql('o', 'u', 15)})), panel as (select * from ix left join wide using (date))"""


def _gap_sql() -> str:
    hole = "(case when price is null then 1 else 0 end)"
    line = "partition by symbol order by date"
    etf = [f"(position + {h} <= last and sum({hole}) over ({line} rows between current row and {h} following) > 0) or (position - {h} >= 0 and lag({hole}, {h}) over ({line}) > 0)" for h in HORIZONS]
    etf.append(f"(position >= {VOL_WINDOW} and sum({hole}) over ({line} rows between {VOL_WINDOW} preceding and current row) > 0)")
    etf.append(f"(position > {VOL_WINDOW} and sum({hole}) over ({line} rows between {VOL_WINDOW + 1} preceding and 1 preceding) > 0)")
    vix = [f"(position + {h} <= last and lead({hole}, {h}) over ({line}) > 0)" for h in HORIZONS]
    return f"""with {_GRID}, days as (select distinct strftime(o_orderdate, '%Y-%m-%d') as date from orders),
ends as (select *, max(position) over (partition by symbol) as last from full_),
judged as (select symbol, date, case when price is null then 'no_price' when case when symbol = '{VIX}' then {' or '.join(vix)} else {' or '.join(etf)} end then 'window' end as problem from ends)
select date, cast(null as varchar) as symbol, 'no_market_day' as problem from days where date not in (select date from axis)
union all select date, symbol, problem from judged where problem is not null and date in (select date from days)"""


_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_CELL = r',(?:"([^"]*(?:""[^"]*)*)(?:"([^,]*)|$)|([^,]*))'


def _cell(k: int) -> str:
    """A field of a CSV line, as a reader of quoted fields has it."""
    return f"""case when c[{k}] like ',"%' then replace(regexp_extract(c[{k}], '{_CELL}', 1), '""', '"') || regexp_extract(c[{k}], '{_CELL}', 2) else c[{k}][2:] end"""


_PRICE_LINES = f"""cells as (select line_id, regexp_extract_all(',' || line, '{_CELL}') as c from raw_price_lines),
named as (select line_id, {_strip(_cell(1))} as d, upper({_strip(_cell(2))}) as s, {_strip(_cell(6))} as close, {_strip(_cell(7))} as adj from cells),
symbols_ as (select line_id, {_day_of('d')} as date, case when s in ('VIX', '{VIX}') then '{VIX}' else s end as symbol, close, adj from named),
texts as (select *, case when symbol in ({', '.join(repr(e) for e in ETFS)}) and adj != '' then adj else close end as text from symbols_),
numbers_ as (select line_id, date, symbol, text, case when regexp_full_match(text, '{_NUMBER}') then try_cast(text as double) end as x from texts),
lines_ as (select line_id, date, symbol, case when x > 0 and x < 'infinity'::double then x end as price from numbers_)"""
_POSITIVE = f"{_strip('criticism_label')} = '1'"
_SCORE = f"case when regexp_full_match({_strip('intensity_score')}, '{_NUMBER}') then try_cast({_strip('intensity_score')} as double) end"
_TERMS = [normalise_here(t) for t in CRITICISM_TERMS]
_STATUS = f"""days as (select cast(d as date) as date from generate_series(date '{START_DATE}', date '{END_DATE}', interval 1 day) g(d)),
wanted as (select query_type, date from days cross join (values ('{ALL_MARKET}'), ('{CANDIDATE}')) q(query_type)),
there as (select distinct query_type, cast({_day_of('t')} as date) as date from (select query_type, {_strip('date')} as t from raw_articles)),
status as (select w.query_type, w.date, t.date is not null as checkpoint_exists from wanted w left join there t on w.query_type = t.query_type and w.date = t.date)"""
_ARTICLE = {c: f"coalesce(json_extract_string(payload, '$.{c}'), '')" for c in ("title", "url", "url_mobile", "domain", "source", "sourceName", "seendate", "language")}

SQL = {
    "normalise_titles": f"select headline_id, {_norm('title')} as normalised_title from headlines",
    "ny_timestamps": _seen(f"select headline_id, coalesce({_STAMP}, '') as seendate_ny, coalesce(strftime(ny, '%Y-%m-%d'), '') as published_date_ny from seen"),
    "trading_days": _seen(f"select headline_id, coalesce(strftime({_WEEKDAY_ROLL}, '%Y-%m-%d'), '') as trading_day from seen"),
    "calendar_asof": _seen(", cal as (select cast(date as date) as d from trading_calendar) select headline_id, coalesce(case when target >= (select min(d) from cal) then strftime(d, '%Y-%m-%d') end, '') as trading_day from seen asof left join cal on target <= d"),
    "calendar_gaps": _seen("select strftime(target, '%Y-%m-%d') as target_date, count(*) as n from seen, (select min(cast(date as date)) as low, max(cast(date as date)) as high from trading_calendar) where target < low or target > high group by target"),
    "flatten_articles": f"""with a as (select raw_id, query_type, coalesce(date, '') as day, {', '.join(f'{v} as "{c}"' for c, v in _ARTICLE.items())} from raw_articles where json_valid(payload)),
b as (select raw_id, query_type, day, title, coalesce(nullif(url, ''), url_mobile) as url, domain, coalesce(nullif(source, ''), nullif("sourceName", ''), domain) as source, seendate, language from a),
e as (select *, coalesce(nullif(replace({_norm('title')}, ' ', ''), ''), replace({_norm('url')}, ' ', '')) as k from b where lower({_strip('language')}) in ('', 'english', 'eng', 'en'))
select raw_id, title, url, domain, source, seendate, language, query_type from e qualify row_number() over (partition by query_type, day, k, lower({_strip('domain')}) order by raw_id) = 1""",
    "dedupe_exact": _seen(f""", c as (select headline_id, {_norm('title')} as normalised_title, coalesce(strftime(ny, '%Y-%m-%d'), '') as published_date_ny, coalesce(strftime({_WEEKDAY_ROLL}, '%Y-%m-%d'), '') as trading_day, lower({_strip('domain')}) as dom from seen)
select headline_id, normalised_title, published_date_ny, trading_day from c qualify row_number() over (partition by coalesce(nullif(published_date_ny, ''), trading_day), normalised_title, dom order by headline_id) = 1"""),
    "daily_index": f"with {_DATED}, cand as (select day, '' as category from rows_ where is_candidate), {_index_sql('rows_', 'cand')}",
    "category_index": f"with {_DATED}, {_MATCHED}, cand as (select day, category from labelled where is_candidate and counts), {_index_sql('rows_', 'cand', categories=True)}",
    "undated_rows": f"with {_DATED} select candidate_id, coalesce(raw_day, '') as value from dated where day is null",
    "label_conflicts": f"""with {_LABELS} select 'url' as key_type, u as key, count(distinct (y, cat)) as "values" from values_l where u != '' group by u having count(distinct (y, cat)) > 1
union all select 'key', kd || '|' || kt || '|' || kdom, count(distinct (y, cat)) from values_l group by kd, kt, kdom having count(distinct (y, cat)) > 1""",
    "label_match": f"with {_DATED}, {_MATCHED} select candidate_id, counts, category from labelled",
    "order_index": f"with {_ORDERS}, {_index_sql('o', 'u')}",
    "price_features": f"with {_LONG} select symbol, date, position, " + ", ".join(f"round({c}, 4) as {c}" for c in ("price", *prices.feature_names(), *(f"fwd_change_{h}d" for h in HORIZONS))) + " from long_",
    "panel": f"{_PANEL} select date, raw_criticism_count, total_market_article_count, " + ", ".join(f"round({c}, 4) as {c}" for c in (INDEX, ZSCORE, *_WIDE_NAMES)) + " from panel",
    "coverage_gaps": _gap_sql(),
    "selected_prices": f"with {_PRICE_LINES} select line_id, date, symbol, round(price, {DIGITS}) as price from lines_",
    "price_conflicts": f'with {_PRICE_LINES} select date, symbol, count(distinct price) as "prices" from lines_ where date is not null and price is not null group by date, symbol having count(distinct price) > 1',
    "event_study": f"""{_PANEL}, p as (select row_number() over (order by date) - 1 as position, {ZSCORE} as z, spy_fwd_log_return_1d as f from panel),
s as (select *, coalesce(sum(f) over w, 0) as s, coalesce(sum(case when f is null then 1 else 0 end) over w, 0) as holes from p window w as (order by position rows between unbounded preceding and 1 preceding)),
e as (select position as event, s as s0 from s where z >= (select quantile_cont(z, 0.9) from s)),
x as (select event, r as relative_day, s0, event + r as position from e cross join range(-10, 22) t(r)),
met as (select x.*, s.s, s.holes from x join s using (position)),
good as (select event from met group by event having count(*) = 32 and max(holes) = min(holes))
select relative_day, round(avg(s - s0), {DIGITS}) as average_cumulative_spy_log_return, count(*) as event_count from met where event in (select event from good) group by relative_day""",
    "ols_simple": f"""{_PANEL}, d as (select spy_fwd_log_return_1d as y, {ZSCORE} as x from panel where spy_fwd_log_return_1d is not null and {ZSCORE} is not null)
select 'const' as term, round(regr_intercept(y, x), {DIGITS}) as coefficient, count(*) as n from d union all select '{ZSCORE}', round(regr_slope(y, x), {DIGITS}), count(*) from d""",
    "keyword_strata": f"""with pool as (select distinct on (pool_id) *, {_norm('title')} as k, {_strip('date')} as d, lower({_strip('domain')}) as dom from annotation_pool),
likely as (select distinct k, d, dom from pool where query_type = '{CANDIDATE}'),
rest as (select distinct k, d, dom from pool where not exists (select 1 from likely l where l.k = pool.k and l.d = pool.d and l.dom = pool.dom)),
named as (select 'likely_criticism' as stratum from likely union all select case when {' or '.join(f"contains(k, '{t}')" for t in _TERMS)} then 'ambiguous' else 'general_market' end from rest)
select stratum, count(*) as n from named group by stratum""",
    "confusion": f"""with c as (select count(*) as total_rows, count(*) filter (where query_type = '{CANDIDATE}') as predicted_positive, count(*) filter (where {_POSITIVE}) as actual_positive, count(*) filter (where query_type = '{CANDIDATE}' and {_POSITIVE}) as true_positive from annotation_labels)
select *, predicted_positive - true_positive as false_positive, actual_positive - true_positive as false_negative, round(true_positive / nullif(predicted_positive, 0)::double, {DIGITS}) as label_precision, round(true_positive / nullif(actual_positive, 0)::double, {DIGITS}) as sample_recall from c""",
    "category_histogram": f"select {_strip('category_label')} as value, count(*) as n from annotation_labels where {_POSITIVE} and {_strip('category_label')} != '' group by 1",
    "intensity_histogram": f"select {_strip('intensity_score')} as value, count(*) as n from annotation_labels where {_POSITIVE} and {_strip('intensity_score')} != '' group by 1",
    "missing_labels": f"select count(*) filter (where {_strip('market_relevant_label')} = '') as market_relevant_label, count(*) filter (where {_strip('criticism_label')} = '') as criticism_label, count(*) filter (where {_POSITIVE} and {_strip('category_label')} = '') as category_label, count(*) filter (where {_POSITIVE} and {_strip('intensity_score')} = '') as intensity_score from annotation_labels",
    "invalid_labels": f"""with r as (select cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_id_within_file from (select count(*) as n from annotation_labels where {_strip('id')} != '' group by {_strip('annotation_file')}, {_strip('id')}))
select c.*, duplicate_id_within_file from (select {', '.join(f"count(*) filter (where {_strip(c)} != '' and {_strip(c)} not in ('0', '1')) as {c}" for c in ('market_relevant_label', 'criticism_label'))},
count(*) filter (where {_strip('category_label')} not in ('', {', '.join(repr(c) for c in CATEGORIES)})) as category_label,
count(*) filter (where {_strip('intensity_score')} != '' and not coalesce({_SCORE} between 0 and 3, false)) as intensity_score,
count(*) filter (where {_strip('category_label')} != '' and not ({_POSITIVE})) as category_label_consistency, count(*) filter (where {_strip('intensity_score')} != '' and not ({_POSITIVE})) as intensity_score_consistency from annotation_labels) c, r""",
    "rater_agreement": f"""with l as (select {_strip('id')} as i, {_strip('annotation_file')} as f, case when {_strip('criticism_label')} in ('0', '1') then cast({_strip('criticism_label')} as int) end as y, label_id as o from annotation_labels),
one as (select i, f, arg_min(y, o) as y, min(o) as o from l where i != '' and y is not null group by i, f),
p as (select a.y as l, b.y as r from one a join one b on a.i = b.i and (a.o, a.f) < (b.o, b.f)),
s as (select count(*) as n, avg(case when l = r then 1.0 else 0.0 end) as same, avg(l) as ly, avg(r) as ry from p),
x as (select *, ly * ry + (1 - ly) * (1 - ry) as expected from s)
select n as paired_items, round(same, {DIGITS}) as criticism_label_percent_agreement, round(case when expected = 1 then 1.0 else (same - expected) / (1 - expected) end, {DIGITS}) as criticism_label_cohens_kappa from x where n > 0""",
    "checkpoint_status": f"with {_STATUS} select query_type, strftime(date, '%Y-%m-%d') as date, checkpoint_exists from status",
    "dry_run": f"""with {_STATUS} select query_type, strftime(min(date), '%Y-%m-%d') as start_date, strftime(max(date), '%Y-%m-%d') as end_date, count(*) as request_count,
count(*) filter (where checkpoint_exists) as existing_checkpoints, count(*) filter (where not checkpoint_exists) as missing_checkpoints, count(*) filter (where not checkpoint_exists) * 10.0::double as estimated_minimum_duration_seconds from status group by query_type""",
    "archive_match": "select doc_id from documents where " + " or ".join(f"contains(lower(text), '{t.lower()}')" for t in CRITICISM_TERMS),
    "streaming_daily": "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1",
}


