"""The daily narrative index: counts, label matching, ratio, rolling z-score, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.checks import CheckError, fail_on
from tapeline.config import CATEGORIES, ROLLING_WINDOW
from tapeline.functions.dates import flexible_day
from tapeline.functions.text import domain_key, filled, normalise_text, strip

DATE_COLUMNS = ("trading_day", "date", "published_date_ny")


def with_day(rows: DataFrame, columns: Sequence[str] = DATE_COLUMNS, name: str = "day") -> DataFrame:
    """`rows` with the day (ISO text) of the first filled date column of each row; null if that one is no day."""
    present = [c for c in columns if c in rows.columns]
    if not present:
        raise CheckError(f"no date column among {', '.join(columns)}")
    return rows.withColumn(name, flexible_day(F.coalesce(*(filled(F.col(c)) for c in present))).cast("string"))


def undated(rows: DataFrame, order: str, columns: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """(order, value): rows without a day, with the value that was tried."""
    present = [c for c in columns if c in rows.columns]
    return with_day(rows, columns, "_day").filter("_day is null").select(order, F.coalesce(*(filled(F.col(c)) for c in present), F.lit("")).alias("value"))


def require_days(rows: DataFrame, order: str, context: str, columns: Sequence[str] = DATE_COLUMNS) -> None:
    fail_on(undated(rows, order, columns), lambda r: f"{context} has rows without a usable date; first {order} {r[0]} value {r[1]!r}", order)


def daily_counts(dated: DataFrame, name: str = "n") -> DataFrame:
    return dated.groupBy("day").agg(F.count(F.lit(1)).alias(name))


def label_value(label: Column) -> Column:
    text = strip(label)
    return F.when(text.isin("0", "1"), text.cast("int"))


def match_key(rows: DataFrame) -> list[Column]:
    title = F.coalesce(F.nullif(F.col("normalised_title"), F.lit("")), F.col("title")) if "normalised_title" in rows.columns else F.col("title")
    return [F.coalesce(F.col("day"), F.lit("")), normalise_text(title), domain_key(F.col("domain"))]


def _keyed_labels(labels: DataFrame) -> DataFrame:
    day, title, domain = match_key(labels)
    return labels.select(strip(F.col("url")).alias("url"), day.alias("day"), title.alias("title_key"), domain.alias("domain_key"), label_value(F.col("criticism_label")).alias("label"), strip(F.col("category_label")).alias("category"))


def label_conflicts(labels: DataFrame) -> DataFrame:
    """(key_type, key, values): URLs and (day, title, domain) keys that carry more than one (label, category)."""
    keyed = _keyed_labels(labels)
    value = F.struct(F.coalesce("label", F.lit(-1)).alias("l"), F.col("category").alias("c"))
    by_url = keyed.filter("url != ''").groupBy(F.col("url").alias("key")).agg(F.countDistinct(value).alias("values")).select(F.lit("url").alias("key_type"), "key", "values")
    by_key = keyed.groupBy(F.concat_ws("|", "day", "title_key", "domain_key").alias("key")).agg(F.countDistinct(value).alias("values")).select(F.lit("key").alias("key_type"), "key", "values")
    return by_url.unionByName(by_key).filter("values > 1")


def match_labels(candidates: DataFrame, labels: DataFrame | None, order: str, strict: bool = True) -> DataFrame:
    """Dated candidates with `counts` (does it count as criticism) and `category`.

    A label is found by the non-blank URL first, then by (day, normalised title, domain); unmatched candidates
    count. `strict` refuses conflicting labels and matched labels other than 0 and 1; otherwise keys in conflict
    match nothing and such labels count. The lookups have one row per key; a candidate always keeps one row.
    """
    if labels is None:
        return candidates.withColumns({"counts": F.lit(True), "category": F.lit("")})
    if strict and candidates.limit(1).count():
        fail_on(label_conflicts(labels), lambda r: f"conflicting labels for {r[0]} {r[1]!r}: use one consensus label", "key_type", "key")
    keyed = _keyed_labels(labels)
    value = F.struct(F.coalesce("label", F.lit(-1)).alias("label"), F.col("category").alias("category"))
    one = [F.min(value).alias("low"), F.max(value).alias("high")]
    by_url = keyed.filter("url != ''").groupBy("url").agg(*one).filter("low = high").select(F.col("url").alias("_url"), F.col("low").alias("_by_url"))
    by_key = keyed.groupBy("day", "title_key", "domain_key").agg(*one).filter("low = high").select(F.col("day").alias("_day"), F.col("title_key").alias("_title"), F.col("domain_key").alias("_domain"), F.col("low").alias("_by_key"))
    day, title, domain = match_key(candidates)
    # a blank URL matches nothing; as a key of its own it doesn't gather with the other blank ones in one task
    url = F.coalesce(F.nullif(strip(F.col("url")), F.lit("")), F.concat(F.lit("\0"), F.col(order).cast("string")))
    rows = candidates.withColumns({"_url": url, "_day": day, "_title": title, "_domain": domain})
    rows = rows.join(by_url, "_url", "left").join(by_key, ["_day", "_title", "_domain"], "left").withColumn("_label", F.coalesce("_by_url", "_by_key"))
    if strict:
        fail_on(rows.filter("_label.label = -1").select(order), lambda r: f"the label matched by {order} {r[0]} is not 0 or 1", order)
    counts = F.col("_label").isNull() | (F.col("_label.label") != 0)
    category = F.when((F.col("_label.label") == 1) & F.col("_label.category").isin(*CATEGORIES), F.col("_label.category")).otherwise("")
    return rows.withColumns({"counts": counts, "category": category}).select(*(F.col(f"`{c}`") for c in candidates.columns), "counts", "category")


def rolling_zscore(value: Column, order: str, window: int = ROLLING_WINDOW) -> Column:
    """Against the last `window` values, this one included; null until there are so many, or if they don't vary."""
    over = Window.orderBy(order).rowsBetween(-(window - 1), 0)  # one row per day after aggregation
    spread = F.stddev_samp(value).over(over)
    return F.when((F.count(value).over(over) == window) & (F.max(value).over(over) > F.min(value).over(over)), (value - F.avg(value).over(over)) / spread)


def numerator_violations(market: DataFrame, candidates: DataFrame) -> DataFrame:
    """(day, candidates, market): days with more counted candidates than market rows, where there are any."""
    both = daily_counts(market, "market").join(daily_counts(candidates.filter("counts"), "candidates"), "day")
    return both.filter("candidates > market").select("day", "candidates", "market")


def daily_index(market: DataFrame, candidates: DataFrame, window: int = ROLLING_WINDOW, index_name: str = "narrative_index", categories: bool | None = None, strict: bool = True) -> DataFrame:
    """One row per market day: counts, the index (their ratio) and its rolling z-score, ordered by day.

    `market` has a `day`; `candidates` a `day`, `counts` and `category` (match_labels). Candidates of days without
    a market row have no place. `strict` refuses days with more counted candidates than market rows. Category
    columns come if any counted candidate has one, or as `categories` says.
    """
    if window <= 0:
        raise CheckError("the rolling window must be positive")
    counted = candidates.filter("counts")
    if categories is None:
        categories = bool(counted.filter("category != ''").limit(1).count())
    extra = [F.count_if(F.col("category") == c).alias(f"raw_criticism_count_{c}") for c in CATEGORIES] if categories else []
    days = daily_counts(market, "total_market_article_count").join(counted.groupBy("day").agg(F.count(F.lit(1)).alias("raw_criticism_count"), *extra), "day", "left")
    names = ["raw_criticism_count", *(f"raw_criticism_count_{c}" for c in CATEGORIES if categories)]
    days = days.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})
    if strict:
        fail_on(numerator_violations(market, candidates), lambda r: f"more candidates than market rows on {r['day']}", "day")
    ratio = lambda n: F.try_divide(F.col(n).cast("double"), F.col("total_market_article_count").cast("double"))
    days = days.withColumn(index_name, ratio("raw_criticism_count")).withColumn(f"{index_name}_rolling_{window}d_zscore", rolling_zscore(F.col(index_name), "day", window))
    by_category = [x for c in CATEGORIES if categories for x in (F.col(f"raw_criticism_count_{c}"), ratio(f"raw_criticism_count_{c}").alias(f"{index_name}_{c}"))]
    return days.select(F.col("day").alias("date"), "raw_criticism_count", "total_market_article_count", index_name, f"{index_name}_rolling_{window}d_zscore", *by_category).orderBy("date")
