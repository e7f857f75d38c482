"""Registered queries of the general data problems (4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.timestamps import zone_version
from tapeline.io import table
from tapeline.operators import rejects, timestamps


def _normalised(spark: SparkSession, sf: str) -> DataFrame:
    headlines = timestamps.normalise_timestamps(table(spark, sf, "headlines"), "headline_id", {"seendate": "utc_second"}, "headlines")
    days = timestamps.normalise_timestamps(table(spark, sf, "index_candidates"), "candidate_id", {"date": "local_day", "published_date_ny": "local_day"}, "index_candidates")
    return headlines.unionByName(days)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(spark, sf).filter(F.col("normal_form").isNotNull()).select("table_name", "row_id", "field_name", "normal_form")


def p4_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    """Values that are no timestamp: their number by field, and the release of the zone tables that the others went by."""
    counted = _normalised(spark, sf).filter(F.col("normal_form").isNull()).groupBy("table_name", "field_name").agg(F.count(F.lit(1)).alias("unresolved_count"))
    return counted.withColumn("zone_data", F.lit(zone_version()))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.parse_price_lines(table(spark, sf, "raw_price_lines"), table(spark, sf, "price_symbols"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected(_parsed(spark, sf))


def p5_prices(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.accepted(_parsed(spark, sf)).withColumn("date", F.col("date").cast("string"))


QUERIES = {"p4_found": p4_found, "p4_unresolved": p4_unresolved, "p5_found": p5_found, "p5_prices": p5_prices}
_FIELD = r'("(?:[^"]|"")*"|[^",]*)'
_LOOSE = _FIELD.replace("(", "(?:", 1)
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _cell(k: int) -> str:
    raw = f"regexp_extract(l, '^{','.join([_FIELD] * 8)}$', {k})"
    return f"trim(case when {raw} like '\"%' then replace({raw}[2:-2], '\"\"', '\"') else {raw} end, {_WHITE})"


_DIAGNOSED = f"""with lines as (select line_id, regexp_replace(coalesce(line, ''), chr(13) || '$', '') as l from raw_price_lines),
cells as (select *, regexp_full_match(l, '{_LOOSE}(,{_LOOSE})*') as quoted, len(string_split(regexp_replace(l, '"(?:[^"]|"")*"', '', 'g'), ',')) = 8 as eight,
  {_cell(1)} as d, upper({_cell(2)}) as s, {_cell(6)} as c from lines),
judged as (select line_id, d, case when s = 'VIX' then '^VIX' else s end as s, c, case when not quoted then 'quoting' when not eight then 'column_count'
  when not regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or try_cast(d as date) is null then 'date'
  when case when s = 'VIX' then '^VIX' else s end not in (select upper(trim(symbol)) from price_symbols) then 'symbol'
  when not regexp_full_match(c, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') or not coalesce(try_cast(c as double) > 0 and try_cast(c as double) < 'infinity'::double, false) then 'close' end as reason from cells)"""

SQL = {
    "p5_found": f"{_DIAGNOSED} select line_id, reason from judged where reason is not null",
    "p5_prices": f"{_DIAGNOSED} select line_id, strftime(cast(d as date), '%Y-%m-%d') as date, s as symbol, cast(c as double) as close from judged where reason is null",
}
