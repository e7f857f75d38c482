"""Price collection: one CSV per symbol, all symbols before anything is written."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from tapeline.config import END_DATE, PRICE_COLUMNS, START_DATE, SYMBOLS
from tapeline.io import guard_output, text_schema, under, write_csv
from tapeline.operators.prices import canonical_symbols
from tapeline.sources.http import FetchError, Retrying, Transport

STATUSES = frozenset((429, 500, 502, 503, 504))


@dataclass(frozen=True)
class PriceSpec:
    endpoint: str
    raw_dir: str
    start: date = START_DATE
    end: date = END_DATE
    symbols: tuple[str, ...] = SYMBOLS
    max_retries: int = 5
    backoff_seconds: float = 60.0
    max_backoff_seconds: float = 900.0
    pause_seconds: float = 5.0

    def check(self) -> None:
        if self.start > self.end:
            raise ValueError("the start must not be after the end")
        if not self.symbols:
            raise ValueError("at least one symbol is needed")
        for name in ("max_retries", "backoff_seconds", "max_backoff_seconds", "pause_seconds"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")


def client_of(spec: PriceSpec, transport: Transport, **options) -> Retrying:
    return Retrying(transport, spec.max_retries, spec.backoff_seconds, spec.max_backoff_seconds, 0.0, spec.pause_seconds, STATUSES, **options)


def unix_seconds(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp())


def output_path(raw_dir: str, symbols: Sequence[str], start: date, end: date) -> str:
    names = "_".join(s.replace("^", "").lower() for s in canonical_symbols(symbols))
    return under(raw_dir, f"prices_{names}_{start:%Y%m%d}_{end:%Y%m%d}.csv")


def fetch_symbol(client: Retrying, endpoint: str, symbol: str, start: date, end: date) -> list[tuple[str, ...]]:
    """PRICE_COLUMNS of each day that has a date and a close; none left is an error."""
    params = {"period1": str(unix_seconds(start)), "period2": str(unix_seconds(end + timedelta(days=1))), "interval": "1d", "events": "history"}
    rows = csv.DictReader(io.StringIO(client.get(f"{endpoint}/{symbol}", params).text))
    tidy = lambda r, c: (r.get(c) or "").strip()
    kept = [(tidy(r, "Date"), symbol, *(tidy(r, c) for c in ("Open", "High", "Low", "Close", "Adj Close", "Volume"))) for r in rows if tidy(r, "Date") and tidy(r, "Close") not in ("", "null", "None")]
    if not kept:
        raise FetchError(f"no usable prices for {symbol}")
    return kept


def preflight(spec: PriceSpec, transport: Transport, **options) -> int:
    """The first symbol without retries: the number of its rows."""
    spec.check()
    client = client_of(spec, transport, **options)
    client.max_retries = 0
    return len(fetch_symbol(client, spec.endpoint, canonical_symbols(spec.symbols)[0], spec.start, spec.end))


def collect_prices(spark: SparkSession, spec: PriceSpec, transport: Transport, **options) -> tuple[str, DataFrame]:
    """(path, rows) after all symbols have come in; an existing file is never replaced."""
    spec.check()
    path = guard_output(output_path(spec.raw_dir, spec.symbols, spec.start, spec.end))
    client = client_of(spec, transport, **options)
    rows = [r for s in canonical_symbols(spec.symbols) for r in fetch_symbol(client, spec.endpoint, s, spec.start, spec.end)]
    df = spark.createDataFrame(rows, text_schema(PRICE_COLUMNS))
    write_csv(df, path)
    return path, df
