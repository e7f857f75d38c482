"""Annotation samples and the validation of labelled files."""

from __future__ import annotations

import random
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.checks import CheckError, fail_on
from tapeline.config import ANNOTATION_COLUMNS, CANDIDATE, CATEGORIES, CRITICISM_TERMS, LABEL_COLUMNS, STRATA
from tapeline.functions import dates
from tapeline.functions.text import contains_any, domain_key, filled, normalise_here, normalise_text, strip
from tapeline.operators.headlines import first_of_each
from tapeline.session import cut_lineage

REQUIRED_SOURCE = ("title", "source", "domain", "url", "query_type")
DATE_SOURCES = ("published_date_ny", "date", "seendate")
SALTS = {"likely_criticism": 11, "ambiguous": 29, "general_market": 47}
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


@dataclass(frozen=True)
class SampleSpec:
    counts: Mapping[str, int] = field(default_factory=lambda: {"likely_criticism": 200, "general_market": 200, "ambiguous": 100})
    seed: int = 1


def export_date(df: DataFrame) -> Column:
    """published_date_ny, else date, else the New York day of seendate; '' if there is none."""
    parts = [filled(F.col(c)) for c in ("published_date_ny", "date") if c in df.columns]
    if "seendate" in df.columns:
        parts.append(dates.in_new_york(dates.utc_timestamp(F.col("seendate"))).cast("date").cast("string"))
    return F.coalesce(*parts, F.lit(""))


def sampling_source(rows: DataFrame, order: str, strict: bool = True) -> DataFrame:
    """`rows` with key columns _title, _date, _domain, the first by `order` of each key."""
    missing = sorted(set(REQUIRED_SOURCE) - set(rows.columns))
    if missing or not set(DATE_SOURCES) & set(rows.columns):
        raise CheckError(f"annotation source lacks columns: {', '.join(missing) or 'a date source'}")
    title = F.coalesce(F.nullif(F.col("normalised_title"), F.lit("")), F.col("title")) if "normalised_title" in rows.columns else F.col("title")
    keyed = rows.withColumns({"_title": normalise_text(title), "_date": export_date(rows), "_domain": domain_key(F.col("domain"))})
    if strict:
        fail_on(keyed.filter("_date = ''").select(order), lambda r: f"annotation source has a row without a usable date: {order} {r[0]}", order)
    return first_of_each(keyed, [F.col("_title"), F.col("_date"), F.col("_domain")], [order])


def strata(candidates: DataFrame, market: DataFrame, order: str, terms=CRITICISM_TERMS, strict: bool = True) -> DataFrame:
    """The deduplicated pool with `stratum`: candidates, market rows with a term in the title, the other market rows."""
    keys = ["_title", "_date", "_domain"]
    likely = sampling_source(candidates, order, strict).withColumn("stratum", F.lit("likely_criticism"))
    rest = sampling_source(market, order, strict).join(likely.select(*keys), keys, "left_anti")
    hit = contains_any(F.col("_title"), [normalise_here(t) for t in terms])
    return likely.unionByName(rest.withColumn("stratum", F.when(hit, "ambiguous").otherwise("general_market")), allowMissingColumns=True)


def draw_positions(n: int, k: int, seed: int, salt: int) -> list[int]:
    """The positions a seeded draw takes of n sorted rows: all if there are no more than k."""
    if k < 0:
        raise CheckError("stratum counts must not be negative")
    return list(range(n)) if n <= k else sorted(random.Random(seed + salt).sample(range(n), k))


def ranked(pool: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(pool with the 0-based `_place` of each row in its stratum by key, rows per stratum).

    Strata are sorted by ranges of the key, as many as the session shuffles into: a range is a task, and its offset is
    the rows of the ranges before it. The ranges are written, as they are drawn by sampling and must not change.
    """
    keys = ["stratum", "_title", "_date", "_domain"]
    spread = cut_lineage(pool.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = cut_lineage(spread.groupBy("stratum", "_part").agg(F.count(F.lit(1)).alias("_m")))
    before = sizes.withColumn("_before", F.sum("_m").over(Window.partitionBy("stratum").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("stratum", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("stratum", "_part").orderBy("_title", "_date", "_domain"))
    placed = spread.withColumn("_inside", inside).join(F.broadcast(before), ["stratum", "_part"])  # parts rows per stratum
    totals = {r[0]: r[1] for r in sizes.groupBy("stratum").agg(F.sum("_m")).collect()}
    return placed.withColumn("_place", F.col("_before") + F.col("_inside") - 1).drop("_inside", "_before", "_part"), totals


def sample(pool: DataFrame, spec: SampleSpec = SampleSpec()) -> tuple[DataFrame, dict[str, int]]:
    """(annotation rows with ids in the order likely, general, ambiguous, shortfall per stratum)."""
    spark = pool.sparkSession
    placed, totals = ranked(pool)
    chosen = [(s, p) for s in STRATA for p in draw_positions(totals.get(s, 0), spec.counts.get(s, 0), spec.seed, SALTS[s])]
    wanted = spark.createDataFrame(chosen, "stratum string, _place bigint")  # as many rows as the sample
    rows = placed.join(F.broadcast(wanted), ["stratum", "_place"])
    rank = F.array_position(F.array(*map(F.lit, STRATA)), F.col("stratum"))
    number = F.row_number().over(Window.orderBy(rank, "_place"))  # the sample only
    columns = {c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("") for c in ("title", "source", "domain", "url", "query_type")}
    out = rows.select(F.format_string("ann_%06d", number).alias("id"), F.col("_date").alias("date"), *(v.alias(c) for c, v in columns.items()), F.col("stratum").alias("sample_stratum"), *(F.lit("").alias(c) for c in LABEL_COLUMNS))
    return out.select(*ANNOTATION_COLUMNS).orderBy("id"), {s: max(0, spec.counts.get(s, 0) - totals.get(s, 0)) for s in STRATA}


def binary_label(value: Column) -> Column:
    text = strip(value)
    return F.when(text.isin("0", "1"), text.cast("int"))


def _positive() -> Column:
    return F.coalesce(binary_label(F.col("criticism_label")) == 1, F.lit(False))


def confusion(labels: DataFrame) -> DataFrame:
    """One row: rows, predicted and actual positives, hits and misses, precision and recall (null if undefined)."""
    predicted = F.coalesce(F.col("query_type") == CANDIDATE, F.lit(False))
    c = labels.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(predicted).alias("predicted_positive"), F.count_if(_positive()).alias("actual_positive"), F.count_if(predicted & _positive()).alias("true_positive"))
    return c.select(
        "*", (F.col("predicted_positive") - F.col("true_positive")).alias("false_positive"), (F.col("actual_positive") - F.col("true_positive")).alias("false_negative"),
        F.try_divide(F.col("true_positive").cast("double"), F.col("predicted_positive").cast("double")).alias("label_precision"), F.try_divide(F.col("true_positive").cast("double"), F.col("actual_positive").cast("double")).alias("sample_recall"),
    )


def label_histogram(labels: DataFrame, column: str) -> DataFrame:
    """(value, n) of a filled label column over the actual positives, ordered by value."""
    return labels.filter(_positive()).select(strip(F.col(column)).alias("value")).filter("value != ''").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy("value")


def missing_labels(labels: DataFrame) -> DataFrame:
    empty = lambda c: strip(F.col(c)) == ""
    return labels.agg(
        *(F.count_if(empty(c)).alias(c) for c in ("market_relevant_label", "criticism_label")),
        *(F.count_if(_positive() & empty(c)).alias(c) for c in ("category_label", "intensity_score")),
    )


def invalid_labels(labels: DataFrame, file_column: str = "annotation_file") -> DataFrame:
    """One row with the number of labels outside of the codebook, at odds with each other, or repeated in a file."""
    text = {c: strip(F.col(c)) for c in LABEL_COLUMNS[:4]}
    score = F.when(text["intensity_score"].rlike(_NUMBER), text["intensity_score"].try_cast("double"))
    good = F.coalesce(score.between(0.0, 3.0), F.lit(False))
    counts = labels.agg(
        *(F.count_if((text[c] != "") & ~text[c].isin("0", "1")).alias(c) for c in ("market_relevant_label", "criticism_label")),
        F.count_if((text["category_label"] != "") & ~text["category_label"].isin(*CATEGORIES)).alias("category_label"),
        F.count_if((text["intensity_score"] != "") & ~good).alias("intensity_score"),
        F.count_if((text["category_label"] != "") & ~_positive()).alias("category_label_consistency"),
        F.count_if((text["intensity_score"] != "") & ~_positive()).alias("intensity_score_consistency"),
    )
    repeated = labels.select(strip(F.col(file_column)).alias("f"), strip(F.col("id")).alias("i")).filter("i != ''").groupBy("f", "i").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_id_within_file"))
    return counts.crossJoin(repeated)  # one row and one row


def rater_pairs(labels: DataFrame, order: str, file_column: str = "annotation_file") -> DataFrame:
    """(paired_items, criticism_label_percent_agreement, criticism_label_cohens_kappa): no row without pairs.

    The first label of each (id, file) counts; within an id, files stand in the order of their first row, and the
    earlier is the left of a pair. Pairs aren't listed: running sums of an id's labels give how many there are of
    each kind, so an item labelled by very many costs a sort, not its square.
    """
    rows = labels.select(strip(F.col("id")).alias("i"), strip(F.col(file_column)).alias("f"), binary_label(F.col("criticism_label")).alias("y"), F.col(order).alias("o")).filter("i != '' and y is not null")
    first = rows.groupBy("i", "f").agg(F.min_by("y", "o").alias("y"), F.min("o").alias("o"))
    earlier = Window.partitionBy("i").orderBy("o", "f").rowsBetween(Window.unboundedPreceding, -1)
    seen = first.withColumns({"n": F.count(F.lit(1)).over(earlier), "yes": F.coalesce(F.sum("y").over(earlier), F.lit(0))})
    c = seen.agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("y") == 1, F.col("yes")).otherwise(F.col("n") - F.col("yes"))).alias("same"), F.sum("yes").alias("left_yes"), F.sum(F.col("y") * F.col("n")).alias("right_yes")).filter("pairs > 0")
    share = {k: F.col(k) / F.col("pairs") for k in ("same", "left_yes", "right_yes")}
    expected = share["left_yes"] * share["right_yes"] + (1 - share["left_yes"]) * (1 - share["right_yes"])
    return c.select(F.col("pairs").alias("paired_items"), share["same"].alias("criticism_label_percent_agreement"), F.when(expected == 1.0, F.lit(1.0)).otherwise((share["same"] - expected) / (1 - expected)).alias("criticism_label_cohens_kappa"))


def validation_report(labels: DataFrame, order: str, file_column: str = "annotation_file") -> dict:
    """Everything above as plain values: a handful of aggregates."""
    one = lambda df: (df.first() or None) and df.first().asDict()
    return {
        **one(confusion(labels)),
        "category_counts": {r[0]: r[1] for r in label_histogram(labels, "category_label").collect()},
        "intensity_distribution": {r[0]: r[1] for r in label_histogram(labels, "intensity_score").collect()},
        "missing_labels": one(missing_labels(labels)),
        "invalid_labels": one(invalid_labels(labels, file_column)),
        "agreement": one(rater_pairs(labels, order, file_column)),
    }


# The lines of the report and their order are what its readers parse.
def format_report(report: Mapping) -> str:
    number = lambda v: "n/a" if v is None else f"{v:.3f}"
    pairs = lambda d: ", ".join(f"{k}={v}" for k, v in d.items()) or "{}"
    lines = ["Annotation validation summary"]
    for title, key in (("Rows", "total_rows"), ("Predicted positives", "predicted_positive"), ("Actual positives", "actual_positive")):
        lines.append(f"{title}: {report[key]}")
    lines += [f"Precision: {number(report['label_precision'])}", f"Sample recall: {number(report['sample_recall'])}"]
    for title, key in (("True positives", "true_positive"), ("False positives", "false_positive"), ("False negatives", "false_negative")):
        lines.append(f"{title}: {report[key]}")
    for title, key in (("Category counts", "category_counts"), ("Intensity distribution", "intensity_distribution"), ("Missing labels", "missing_labels"), ("Invalid labels", "invalid_labels")):
        lines.append(f"{title}: {pairs(report[key])}")
    if report.get("agreement"):
        lines.append(f"Inter-annotator agreement: {pairs(report['agreement'])}")
    return "\n".join(lines)
