"""Mixed timestamp formats and time zones, as an operator on DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions import timestamps as ts

#: What str.strip() strips, as a Java character class: outer blanks of a value.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Plain forms; \z, as $ would let a final line feed pass.
PLAIN = {"utc_second": r"^[0-9]{14}\z", "local_day": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"}


@F.pandas_udf(T.StringType())
def _utc_second(v: pd.Series) -> pd.Series:
    return _by_distinct(v, ts.to_utc_second)


@F.pandas_udf(T.StringType())
def _ny_day(v: pd.Series) -> pd.Series:
    return _by_distinct(v, ts.to_local_day)


def _by_distinct(v: pd.Series, convert) -> pd.Series:
    codes, distinct = pd.factorize(v.str.strip(), use_na_sentinel=True)
    out = pd.Series([*convert(list(distinct)), None], dtype=object)
    return pd.Series(out.to_numpy()[codes])


def utc_second(value: Column) -> Column:
    """UTC `yyyy-MM-dd HH:mm:ss` of a text; null for null, blank, days without a time and what is no instant."""
    return _utc_second(value)


def ny_day(value: Column) -> Column:
    """New York `yyyy-MM-dd` of a text; null for null, blank and what is no day."""
    return _ny_day(value)


def normalise_timestamps(df: DataFrame, row_id: str, fields: Mapping[str, str], table_name: str) -> DataFrame:
    """(table_name, row_id, field_name, raw_value, normal_form) of every value not yet in its plain form.

    `fields` maps a column to `utc_second` (plain: 14 digits, UTC) or `local_day` (plain: ISO day, New York).
    Rows with a null or blank value give nothing; a value that can't be resolved has a null normal_form. Values
    in plain form never leave the JVM, so only the odd ones are sent to Python. Repeated rows give repeated
    results, an empty table an empty one; other columns are not read, whatever their names.
    """
    out = None
    for field, kind in fields.items():
        value = F.col(f"`{field}`")
        odd = df.select(F.col(f"`{row_id}`").alias("row_id"), value.cast("string").alias("raw_value")).filter(F.col("raw_value").isNotNull() & ~F.col("raw_value").rlike(PLAIN[kind]) & F.col("raw_value").rlike(rf"(?s)[^\s\x1c-\x1f\x85\p{{Z}}]"))
        part = odd.select(
            F.lit(table_name).alias("table_name"), "row_id", F.lit(field).alias("field_name"), "raw_value",
            (utc_second if kind == "utc_second" else ny_day)(F.col("raw_value")).alias("normal_form"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def resolved(df: DataFrame, column: str, kind: str) -> Column:
    """The normal form of a column for every row, plain values converted in the JVM, the others through the masks."""
    value = F.col(f"`{column}`")
    odd = F.when(~value.rlike(PLAIN[kind]), value)
    if kind == "local_day":
        return F.coalesce(F.when(value.rlike(PLAIN[kind]) & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), value), ny_day(odd))
    plain = F.try_to_timestamp(F.when(value.rlike(PLAIN[kind]), value), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(F.date_format(plain, "yyyy-MM-dd HH:mm:ss"), utc_second(odd))
