"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.plans.groups import attach
from tapeline.session import cut_lineage

#: Blanks (Unicode white space, separators and the four control separators) and punctuation (category P).
_NOISE = r"[\s\p{Z}\x1c-\x1f\x85\p{P}]+"
_BLANK = r"^[\s\p{Z}\x1c-\x1f\x85]*\z"
#: Between the canonical fields; no field can hold it, as it counts as a blank.
_BREAK = "\x1f"


def canonical(value: Column) -> Column:
    """A text without letter case, blanks and punctuation. A ß is what its capitals are, ss."""
    return F.regexp_replace(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), _NOISE, "")


def is_blank(value: Column) -> Column:
    return value.isNull() | value.rlike(_BLANK)


def canonical_records(df: DataFrame, row_id: str, fields: Sequence[str], characters: Callable[[Column], Column] | None = None) -> DataFrame:
    """(row_id, record): the canonical fields in the order of their names, whatever the order they came in.

    `characters` brings a text to one form of its characters first, such as glyphs.consistent_form (wide, combining
    and look-alike forms, invisible characters); without it only case, blanks and punctuation are disregarded. Rows with a null or blank field are left out; a field of punctuation only counts as empty, not as blank.
    """
    values = [F.col(f"`{f}`").cast("string") for f in sorted(fields)]
    whole = ~F.lit(False)
    for v in values:
        whole = whole & ~is_blank(v)
    same = characters or (lambda v: v)
    return df.filter(whole).select(F.col(f"`{row_id}`").alias("row_id"), F.concat_ws(_BREAK, *(canonical(same(v)) for v in values)).alias("record"))


def json_fields(df: DataFrame, row_id: str, payload: str, fields: Sequence[str]) -> DataFrame:
    """(row_id, fields...) of one JSON object per row, whatever its layout and key order; a broken one gives nulls."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    return df.select(F.col(f"`{row_id}`").alias("row_id"), F.from_json(F.col(f"`{payload}`"), schema).alias("_p")).select("row_id", *(F.col("_p").getField(f).alias(f) for f in fields))


def count_copies(records: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, groups) of (by..., row_id, record).

    Rows get a 128-bit hash and a second, independent 64-bit one, and are written so, about 40 bytes each: texts are
    read and made canonical once. Groups have one row per hash: copies and the smallest row_id, aggregated map-side
    first, so a group that holds a third of all rows costs no more than any other. Where the second hash says that
    two different records share the 128 bits, exactly those groups are told apart by their whole record.
    """
    by = list(by)
    hashed = F.unhex(F.md5(F.encode("record", "UTF-8")))
    keyed = cut_lineage(records.select(*by, "row_id", hashed.alias("key"), F.xxhash64("record").alias("check")))
    # the smallest and largest second hash of a group differ only if the 128 bits collide
    count = lambda rows, *more: rows.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("first_id"), *more)
    groups = count(keyed, F.min("check").alias("low"), F.max("check").alias("high"))
    split = groups.filter("low != high").select(*by, "key").collect()  # 2**-128 a pair: a handful at most
    if split:
        collided = F.broadcast(keyed.sparkSession.createDataFrame(split, groups.select(*by, "key").schema).withColumn("hit", F.lit(1)))
        apart = records.select(*by, "row_id", hashed.alias("key"), "record").join(collided, [*by, "key"], "left")
        keyed = cut_lineage(apart.select(*by, "row_id", F.when(F.col("hit") == 1, F.concat("key", F.encode("record", "UTF-8"))).otherwise(F.col("key")).alias("key")))
        groups = count(keyed)
    return keyed.drop("check"), groups.select(*by, "key", "copies", "first_id")


def find_copies(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., first_id, copy_id): one row for every row that is not the first of its record.

    Records are (by..., row_id, record) as of canonical_records, row ids unique within `by`. Ties can't occur;
    an empty input gives an empty result. Rows meet their group by attach(), which no hot group can stall.
    """
    keyed, groups = count_copies(records, by)
    repeated = cut_lineage(groups.filter("copies > 1"))
    return attach(keyed, repeated, [*by, "key"], "copies").filter(F.col("row_id") != F.col("first_id")).select(*by, "first_id", F.col("row_id").alias("copy_id"))
