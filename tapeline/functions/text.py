"""Text functions on columns: all in the JVM but for the compatibility form, which only non-ASCII text needs."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Punctuation that separates words; all other punctuation is dropped. A fixed value.
SEPARATORS = "-‐‑‒–—―/\\_"
_SEPARATORS = r"[-‐‑‒–—―/\\_]"
WHITE = " \t\n\r\f\x0b"


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """NFKC. ASCII text, which it never changes, doesn't leave the JVM."""
    plain = text.rlike(r"^\p{ASCII}*\z")
    return F.when(plain, text).otherwise(_compatible(F.when(~plain, text)))


def normalise_text(text: Column) -> Column:
    """NFKC, lower case, separators as blanks, other punctuation dropped, blanks collapsed and trimmed; null is ''."""
    value = F.lower(compatible(F.coalesce(text, F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(value, _SEPARATORS, " "), r"\p{P}", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Outer white space off; null is ''."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def filled(text: Column) -> Column:
    """The stripped text, or null if nothing is left: for coalesce()."""
    return F.nullif(strip(text), F.lit(""))


def domain_key(text: Column) -> Column:
    return F.lower(strip(text))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term is in the text, also within words. `terms` should be normalised like the text."""
    out = F.lit(False)
    for t in terms:
        if t:
            out = out | text.contains(t)
    return out


def normalise_here(text: str) -> str:
    """normalise_text() for settings on the driver."""
    lowered = unicodedata.normalize("NFKC", text).lower()
    kept = (" " if c in SEPARATORS else "" if unicodedata.category(c).startswith("P") else c for c in lowered)
    return " ".join("".join(kept).split())
