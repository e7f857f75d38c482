"""Market features of a long price table: returns, volatility, drawdown, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.checks import CheckError, fail_on, require_columns
from tapeline.config import ETFS, HORIZONS, SYMBOLS, VIX, VOL_WINDOW
from tapeline.functions.dates import flexible_day
from tapeline.functions.text import filled, strip

TRADING_DAYS = 252
#: A field of a CSV line after its comma: between quotes (inner ones doubled), with what stands after them, or plain.
_FIELD = r',(?:"([^"]*+(?:""[^"]*+)*+)(?:"([^,]*+)|\z)|([^,]*+))'


def csv_fields(line: Column) -> Column:
    """The fields of a CSV line as the reference's reader sees them: quotes taken off, commas inside them kept.

    A quote inside a plain field is a character like any other; a quoted field that is never closed goes to the end.
    """
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, _FIELD, k)
    quoted = F.transform(cells, lambda x: F.when(x.startswith(',"'), F.concat(F.replace(part(x, 1), F.lit('""'), F.lit('"')), part(x, 2))).otherwise(F.substring(x, 2, 2**31 - 1)))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ","))


def canonical_symbol(symbol: Column) -> Column:
    text = F.upper(strip(symbol))
    return F.when(text.isin("VIX", VIX), VIX).otherwise(text)


def canonical_symbols(symbols: Sequence[str]) -> tuple[str, ...]:
    """Stripped, upper case, VIX as ^VIX, each once, in order."""
    tidy = (VIX if (s or "").strip().upper() in ("VIX", VIX) else (s or "").strip().upper() for s in symbols)
    return tuple(dict.fromkeys(tidy))


def prefix_of(symbol: str) -> str:
    return "vix" if canonical_symbols([symbol])[0] == VIX else canonical_symbols([symbol])[0].lower()


def select_prices(rows: DataFrame, order: str | None = None) -> DataFrame:
    """(date, symbol, price, text[, order]): the adjusted close of an ETF if there is one, else the close; null if no positive finite number."""
    require_columns(rows, ("date", "symbol", "close"), "prices")
    symbol = canonical_symbol(F.col("symbol"))
    close = strip(F.col("close").cast("string"))
    chosen = F.coalesce(F.when(symbol.isin(*ETFS), filled(F.col("adj_close").cast("string"))), close) if "adj_close" in rows.columns else close
    number = F.when(chosen.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), chosen.try_cast("double"))
    price = F.when((number > 0) & (number < float("inf")), number)
    return rows.select(flexible_day(F.col("date").cast("string")).alias("date"), symbol.alias("symbol"), price.alias("price"), chosen.alias("text"), *([order] if order else []))


def price_conflicts(prices: DataFrame) -> DataFrame:
    """(date, symbol, prices): days with different prices of one symbol."""
    return prices.groupBy("date", "symbol").agg(F.countDistinct(F.coalesce("price", F.lit(-1.0))).alias("prices")).filter("prices > 1")


def missing_symbols(prices: DataFrame, symbols: DataFrame, by: str | None = None) -> DataFrame:
    """([by,] symbol): the symbols of a frame (column `symbol`) that have no row in `prices`, in each value of `by` if given."""
    wanted = symbols.select(canonical_symbol(F.col("symbol")).alias("symbol")).filter("symbol != ''").distinct()
    keys = ["symbol"] if by is None else [by, "symbol"]
    if by is not None:
        wanted = prices.select(by).distinct().join(F.broadcast(wanted))  # some symbols per period
    return wanted.join(prices.select(*keys).distinct(), keys, "left_anti").select(*keys)


def unusable_prices(long: DataFrame, order: str) -> DataFrame:
    """(order, symbol, text): rows whose price is no positive finite number."""
    return long.filter("price is null").select(order, "symbol", "text")


def repeated_days(rows: DataFrame, date: str = "date") -> DataFrame:
    """(date, n): days that stand more than once."""
    return rows.groupBy(F.col(date).alias("date")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first_prices(long: DataFrame, order: str) -> DataFrame:
    """(date, symbol, price): of each day and symbol the price of its first row by `order`; rows without a day or price are passed over."""
    return long.filter("date is not null and price is not null").groupBy("date", "symbol").agg(F.min_by("price", order).alias("price"))


def carried_forward(full: DataFrame) -> DataFrame:
    """(date, symbol, price) of a grid, gaps filled with the last price before them."""
    before = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("date", "symbol", F.last("price", ignorenulls=True).over(before).alias("price"))


def checked_prices(rows: DataFrame, order: str, symbols: Sequence[str] = SYMBOLS) -> DataFrame:
    """(date, symbol, price), one row each. Refuses undated rows, bad prices, absent symbols and conflicting repeats."""
    long = select_prices(rows, order)
    fail_on(long.filter("date is null"), lambda r: f"prices has a row without a usable date: {order} {r[order]}", order)
    required = rows.sparkSession.createDataFrame([(x,) for x in canonical_symbols(symbols)], "symbol string")
    absent = [r[0] for r in missing_symbols(long, required).collect()]  # at most len(symbols)
    if absent:
        raise CheckError(f"prices lacks required symbols: {', '.join(x for x in canonical_symbols(symbols) if x in absent)}")
    fail_on(unusable_prices(long, order), lambda r: f"prices has an unusable price: {order} {r[order]} value {r['text']!r}", order)
    fail_on(price_conflicts(long), lambda r: f"conflicting prices for {r['symbol']} on {r['date']}", "date", "symbol")
    return long.groupBy("date", "symbol").agg(F.min("price").alias("price"))


def grid(prices: DataFrame, symbols: Sequence[str] = SYMBOLS) -> DataFrame:
    """(symbol, date, position, price): every required symbol on every day of the axis, gaps null.

    The axis is all days of all symbols in `prices`, required or not; `position` counts them from 0.
    """
    axis = prices.select("date").distinct().withColumn("position", F.row_number().over(Window.orderBy("date")) - 1)  # one row per day
    spread = axis.withColumn("symbol", F.explode(F.array(*map(F.lit, canonical_symbols(symbols)))))
    return spread.join(prices.select("date", "symbol", "price"), ["date", "symbol"], "left").select("symbol", "date", "position", "price")


def long_features(full: DataFrame, horizons: Sequence[int] = HORIZONS, vol_window: int = VOL_WINDOW) -> DataFrame:
    """The grid with every feature of each (symbol, day); one partitioning and one sort serve all windows."""
    if not horizons or min(horizons) <= 0:
        raise CheckError("horizons must be positive")
    if vol_window < 2:
        raise CheckError("the volatility window must be at least 2")
    line = Window.partitionBy("symbol").orderBy("date")
    p, r, year = F.col("price"), F.col("r"), F.sqrt(F.lit(float(TRADING_DAYS)))
    out = full.withColumn("r", F.log(p / F.lag(p).over(line)))
    past = line.rowsBetween(-(vol_window - 1), 0)
    vol = F.when(F.count(r).over(past) == vol_window, F.stddev_samp(r).over(past) * year)
    new = {f"realized_vol_{vol_window}d": vol}
    for h in horizons:
        ahead = line.rowsBetween(1, h)
        new[f"fwd_log_return_{h}d"] = F.log(F.lead(p, h).over(line) / p)
        new[f"lag_log_return_{h}d"] = F.log(p / F.lag(p, h).over(line))
        new[f"fwd_realized_vol_{h}d"] = F.when(F.count(r).over(ahead) == h, F.sqrt(F.avg(r * r).over(ahead)) * year)
        new[f"fwd_max_drawdown_{h}d"] = F.when(p.isNotNull() & (F.count(p).over(ahead) == h), F.least(F.lit(0.0), F.min(p).over(ahead) / p - 1))
        new[f"fwd_change_{h}d"] = F.lead(p, h).over(line) - p
    out = out.withColumns(new)
    return out.withColumn(f"lag_realized_vol_{vol_window}d", F.lag(f"realized_vol_{vol_window}d").over(line))


def feature_names(horizons: Sequence[int] = HORIZONS, vol_window: int = VOL_WINDOW) -> list[str]:
    """The feature columns of an ETF, in output order."""
    return [
        *(f"fwd_log_return_{h}d" for h in horizons), *(f"fwd_realized_vol_{h}d" for h in horizons), *(f"lag_log_return_{h}d" for h in horizons),
        f"realized_vol_{vol_window}d", f"lag_realized_vol_{vol_window}d", *(f"fwd_max_drawdown_{h}d" for h in horizons),
    ]


def wide_features(long: DataFrame, symbols: Sequence[str] = SYMBOLS, horizons: Sequence[int] = HORIZONS, vol_window: int = VOL_WINDOW) -> DataFrame:
    """One row per day: the features of every ETF under its prefix, then level and changes of the volatility index."""
    columns = []
    for s in canonical_symbols(symbols):
        mine = F.col("symbol") == s
        if s in ETFS:
            columns += [F.max(F.when(mine, F.col(f))).alias(f"{prefix_of(s)}_{f}") for f in feature_names(horizons, vol_window)]
        elif s == VIX:
            columns += [F.max(F.when(mine, F.col("price"))).alias("vix_level"), *(F.max(F.when(mine, F.col(f"fwd_change_{h}d"))).alias(f"vix_fwd_change_{h}d") for h in horizons)]
    return long.groupBy("date").agg(*columns)


def coverage_gaps(index_days: DataFrame, full: DataFrame, symbols: Sequence[str] = SYMBOLS, horizons: Sequence[int] = HORIZONS, vol_window: int = VOL_WINDOW) -> DataFrame:
    """(date, symbol, problem): what the features of each index day lack.

    `no_market_day`: not on the axis; `no_price`: no price that day; `window`: a gap inside a window that lies fully
    on the axis. All windows are counts of nulls over row frames, so no day is looked up one by one.
    """
    days = index_days.select("date").distinct()
    axis = full.select("date").distinct()
    absent = days.join(axis, "date", "left_anti").select("date", F.lit(None).cast("string").alias("symbol"), F.lit("no_market_day").alias("problem"))
    line = Window.partitionBy("symbol").orderBy("date")
    hole = F.col("price").isNull().cast("int")
    whole = F.max("position").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = F.col("position")
    etf, bad, vix_bad = F.col("symbol").isin(*ETFS), F.lit(False), F.lit(False)
    for h in horizons:
        bad = bad | ((at + h <= F.col("_last")) & (F.sum(hole).over(line.rowsBetween(0, h)) > 0)) | ((at - h >= 0) & (F.lag(hole, h).over(line) > 0))
        vix_bad = vix_bad | ((at + h <= F.col("_last")) & (F.lead(hole, h).over(line) > 0))
    bad = bad | ((at >= vol_window) & (F.sum(hole).over(line.rowsBetween(-vol_window, 0)) > 0)) | ((at > vol_window) & (F.sum(hole).over(line.rowsBetween(-vol_window - 1, -1)) > 0))
    seen = full.filter(F.col("symbol").isin(*canonical_symbols(symbols))).withColumn("_last", whole).withColumn("_bad", F.when(etf, bad).otherwise(vix_bad))
    problem = F.when(F.col("price").isNull(), "no_price").when(F.col("_bad"), "window")
    return absent.unionByName(seen.withColumn("problem", problem).filter("problem is not null").join(days, "date", "left_semi").select("date", "symbol", "problem"))


def build_panel(index: DataFrame, prices: DataFrame, symbols: Sequence[str] = SYMBOLS, horizons: Sequence[int] = HORIZONS, vol_window: int = VOL_WINDOW, strict: bool = True) -> DataFrame:
    """The index rows, all of them and in order, with the market features of their day."""
    fail_on(repeated_days(index), lambda r: f"the index has {r['date']} more than once", "date")
    full = grid(prices, symbols).withColumn("date", F.col("date").cast("string"))
    if strict:
        fail_on(coverage_gaps(index, full, symbols, horizons, vol_window), lambda r: f"{r['problem']}: {r['symbol'] or 'all symbols'} on {r['date']}", "date", "symbol")
    features = wide_features(long_features(full, horizons, vol_window), symbols, horizons, vol_window)
    return index.join(features, "date", "left").orderBy("date")
