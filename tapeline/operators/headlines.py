"""Headlines: flattening raw payloads, cleaning, trading days, exact and fuzzy deduplication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import dates
from tapeline.functions.text import domain_key, normalise_text, strip
from tapeline.session import cut_lineage

ENGLISH = ("english", "eng", "en")
ARTICLE = "title string, url string, url_mobile string, domain string, source string, sourceName string, seendate string, language string"
PAYLOAD = f"query_type string, start_date string, end_date string, source_language string, responses array<struct<date: string, query: string, response: struct<articles: array<struct<{', '.join(f.replace(' ', ': ') for f in ARTICLE.split(', '))}>>>>>"
DERIVED = ("normalised_title", "seendate_ny", "published_date_ny", "trading_day")
#: A calendar is broadcast up to so many days (over 2,700 years); a longer one is joined by a shuffle.
MAX_CALENDAR = 1_000_000


class CoverageError(ValueError):
    """A calendar that doesn't reach a target day."""


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty (blanks count as filled), else ''."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def article_rows(articles: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Article structs in column `article` (null: no object) to the fixed fields; `keep` are columns passed on."""
    a = F.col("article")
    return articles.filter(a.isNotNull()).select(
        *keep,
        _or_empty(a["title"]).alias("title"), _first_filled(a["url"], a["url_mobile"]).alias("url"), _or_empty(a["domain"]).alias("domain"),
        _first_filled(a["source"], a["sourceName"], a["domain"]).alias("source"), _or_empty(a["seendate"]).alias("seendate"), _or_empty(a["language"]).alias("language"),
    )


def keep_language(rows: DataFrame, source_language: str) -> DataFrame:
    """For an English collection the English rows and those without a language; others are not filtered."""
    if source_language.strip().lower() not in ENGLISH:
        return rows
    language = F.lower(strip(F.col("language")))
    return rows.filter(language.isin("", *ENGLISH))


def first_of_each(rows: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order`, which must be unique. Aggregated with min_by, so map-side first."""
    names = [f"_k{i}" for i in range(len(keys))]
    keep = rows.columns
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return rows.groupBy(*(k.alias(n) for k, n in zip(keys, names))).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in keep)), by).alias("_r")).select(*(F.col("_r").getField(c).alias(c) for c in keep))


def article_keys(day: Column) -> list[Column]:
    """What makes two articles of a response one: the day, the title (or else the URL) without blanks, the domain."""
    title = F.regexp_replace(normalise_text(F.col("title")), " ", "")
    url = F.regexp_replace(normalise_text(F.col("url")), " ", "")
    return [day, F.coalesce(F.nullif(title, F.lit("")), url), domain_key(F.col("domain"))]


def flatten_payload(payload: DataFrame, query_type: str | None = None, order: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Payload rows (schema PAYLOAD) to articles, in order, filtered by language, the first of each key kept.

    `order`: columns that put several payload rows in order; `keep`: columns that are passed on. Blocks, responses and
    articles that are null give nothing.
    """
    more = list(dict.fromkeys([*order, *keep]))
    blocks = payload.select(*more, F.col("query_type").alias("_type"), _or_empty(F.col("source_language")).alias("_language"), F.posexplode("responses").alias("_b", "block"))
    articles = blocks.filter("block is not null").select(*more, "_type", "_language", "_b", _or_empty(F.col("block.date")).alias("_day"), F.posexplode("block.response.articles").alias("_a", "article"))
    rows = article_rows(articles, (*more, "_type", "_language", "_b", "_a", "_day")).filter(~F.lower(strip(F.col("_language"))).isin(*ENGLISH) | F.lower(strip(F.col("language"))).isin("", *ENGLISH))
    first = first_of_each(rows, [F.col("_type"), *article_keys(F.col("_day"))], [*order, "_b", "_a"])
    return first.orderBy(*order, "_b", "_a").select(*keep, "title", "url", "domain", "source", "seendate", "language", (F.lit(query_type) if query_type else F.col("_type")).alias("query_type"))


def flatten_deliveries(deliveries: DataFrame, source_language: str = "english", order: str = "raw_id", day: str = "date", payload: str = "payload") -> DataFrame:
    """One article object as JSON text per row to articles; keyed by (query_type, day), the smallest `order` kept."""
    parsed = deliveries.select(order, "query_type", _or_empty(F.col(day)).alias("_day"), F.from_json(F.col(payload), ARTICLE).alias("article"))
    rows = keep_language(article_rows(parsed, (order, "query_type", "_day")), source_language)
    return first_of_each(rows, [F.col("query_type"), *article_keys(F.col("_day"))], [order]).drop("_day")


def calendar_map(calendar: DataFrame, column: str = "date") -> DataFrame:
    """(target, trading_day): every day from the first to the last of the calendar with the next trading day."""
    days = calendar.select(F.try_to_date(F.col(column).cast("string"), "yyyy-MM-dd").alias("trading_day")).filter("trading_day is not null").distinct()
    before = F.lag("trading_day").over(Window.orderBy("trading_day"))  # one row per trading day: small for any span of time
    return days.withColumn("_after", F.coalesce(F.date_add(before, 1), F.col("trading_day"))).select(F.explode(F.sequence("_after", "trading_day")).alias("target"), "trading_day")


def _mapped(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    days = calendar_map(calendar).withColumnRenamed("target", "_target").withColumnRenamed("trading_day", "_trading_day")
    small = days.limit(MAX_CALENDAR + 1).count() <= MAX_CALENDAR
    return rows.join(F.broadcast(days) if small else days, "_target", "left")


def clean_headlines(rows: DataFrame, calendar: DataFrame | None = None, title: str = "title", seendate: str = "seendate", strict: bool = False) -> DataFrame:
    """`rows` with normalised_title, seendate_ny, published_date_ny and trading_day, '' where there is none.

    Without a calendar weekends are skipped. With one, a target day outside of it has no trading day; `strict`
    makes that an error that names the first such day. Existing columns of those names are replaced. Rows without a
    title column have their title in `headline`; an empty title stays one.
    """
    if title not in rows.columns and "headline" in rows.columns:
        title = "headline"
    utc = dates.utc_timestamp(F.col(f"`{seendate}`"))
    out = rows.drop(*DERIVED).withColumn("_utc", utc).withColumn("_ny", dates.in_new_york(F.col("_utc"))).withColumn("_target", dates.target_date(F.col("_ny")))
    if calendar is None:
        out = out.withColumn("_trading_day", dates.next_weekday(F.col("_target")))
    else:
        if strict:
            first = uncovered_days(rows, calendar, seendate).orderBy("target_date").limit(1).collect()
            if first:
                raise CoverageError(f"the trading calendar does not cover target date {first[0][0]}")
        out = _mapped(out, calendar)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in DERIVED]
    return out.select(
        *kept,
        normalise_text(F.col(f"`{title}`")).alias("normalised_title"),
        _or_empty(dates.iso_with_offset(F.col("_ny"), F.col("_utc"))).alias("seendate_ny"),
        _or_empty(F.col("_ny").cast("date").cast("string")).alias("published_date_ny"),
        _or_empty(F.col("_trading_day").cast("string")).alias("trading_day"),
    )


def uncovered_days(rows: DataFrame, calendar: DataFrame, seendate: str = "seendate") -> DataFrame:
    """(target_date, n): target days before the calendar's first or after its last day."""
    target = dates.target_date(dates.in_new_york(dates.utc_timestamp(F.col(f"`{seendate}`"))))
    span = calendar.agg(F.min("date").cast("date").alias("_low"), F.max("date").cast("date").alias("_high"))
    counted = rows.select(target.alias("target_date")).filter("target_date is not null").groupBy("target_date").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(span), (F.col("target_date") < F.col("_low")) | (F.col("target_date") > F.col("_high"))).select("target_date", "n")  # span: one row


def dedupe_day(columns: Sequence[str]) -> Column:
    """The first filled one of published_date_ny, date and trading_day; columns that aren't there are passed over."""
    return _first_filled(*(F.col(c) for c in ("published_date_ny", "date", "trading_day") if c in columns))


def dedupe_exact(cleaned: DataFrame, order: str, domain: str = "domain") -> DataFrame:
    """Cleaned headlines, the first by `order` of each (day, normalised title, domain). Nulls in the domain are ''."""
    return first_of_each(cleaned, [dedupe_day(cleaned.columns), F.col("normalised_title"), domain_key(F.col(domain))], [order])


def dedupe_fuzzy(cleaned: DataFrame, order: str, threshold: float = 0.96, domain: str = "domain") -> DataFrame:
    """After dedupe_exact: rows whose title is as close as `threshold` to a kept earlier one of their day and domain go.

    Greedy in the order of `order`, so each (day, domain) is one sequence; that is the definition, not a choice.
    Groups are sorted runs of a partition that stream through one generator, so a group is never collected, and
    groups of one row never leave the JVM. Titles that can't reach the threshold by their letter counts are
    skipped before the full ratio.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    exact = dedupe_exact(cleaned, order, domain).withColumn("_day", dedupe_day(cleaned.columns)).withColumn("_domain", domain_key(F.col(domain)))
    keys = ["_day", "_domain"]
    slim = cut_lineage(exact.select(*keys, F.col(order).alias("_o"), "normalised_title"))
    several = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    runs = slim.join(several, keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "_o")
    removed = runs.mapInPandas(_near_earlier(threshold), f"_o {slim.schema['_o'].dataType.simpleString()}")
    return exact.join(removed, exact[order] == removed["_o"], "left_anti").drop(*keys)


def _letters(title: str) -> np.ndarray:
    """Letters counted in 64 bins; merging letters only weakens the bound that is taken from it."""
    return np.bincount(np.frombuffer(title.encode("utf-32-le"), np.uint32) % 64, minlength=64).astype(np.int32)


def _near_earlier(threshold: float):
    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, kept, counts, lengths = None, [], np.zeros((0, 64), np.int32), np.zeros(0, np.int64)
        matcher = SequenceMatcher(None)
        for b in batches:
            gone = []
            for day, domain, o, title in zip(b["_day"], b["_domain"], b["_o"], b["normalised_title"]):
                if (day, domain) != group:
                    group, kept = (day, domain), []
                mine, near = _letters(title), False
                # no more letters can match than both titles have: an exact bound on the ratio
                apart = np.abs(counts[: len(kept)] - mine).sum(axis=1)
                for k in np.flatnonzero(apart <= (1 - threshold) * (lengths[: len(kept)] + len(title)) + 1e-9):
                    matcher.set_seqs(title, kept[k])
                    if matcher.ratio() >= threshold:
                        near = True
                        break
                if near:
                    gone.append(o)
                    continue
                if len(kept) == len(counts):
                    counts = np.vstack([counts, np.zeros((max(16, len(counts)), 64), np.int32)])
                    lengths = np.concatenate([lengths, np.zeros(max(16, len(lengths)), np.int64)])
                counts[len(kept)], lengths[len(kept)] = mine, len(title)
                kept.append(title)
            yield pd.DataFrame({"_o": pd.Series(gone, dtype=b["_o"].dtype)})

    return removed
