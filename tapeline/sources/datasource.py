"""Custom Spark data sources over injected fetchers: `news_days`, one partition per day, and `symbol_prices`, one per symbol.

Options: `fetcher` = "module:function"; for news `start`, `end` (ISO days), `query`; for prices `symbols`
(comma-separated), `start`, `end`. A news fetcher takes (day, options) and returns articles as dicts, a price
fetcher (symbol, options) and returns PRICE_COLUMNS tuples. Spark retries a failed partition by itself.
"""

from __future__ import annotations

import importlib
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tapeline.config import PRICE_COLUMNS

ARTICLE = ("title", "url", "url_mobile", "domain", "source", "sourceName", "seendate", "language")


def _function(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class _Reader(DataSourceReader):
    def __init__(self, options, keys, rows):
        self.options, self.keys, self.rows = dict(options), keys, rows

    def partitions(self):
        return [InputPartition(k) for k in self.keys]

    def read(self, partition):
        yield from self.rows(partition.value, self.options)


def _news_rows(day, options):
    for n, a in enumerate(_function(options["fetcher"])(day, options)):
        if isinstance(a, dict):
            yield (day, options.get("query", ""), n, *(None if a.get(c) is None else str(a[c]) for c in ARTICLE))


def _price_rows(symbol, options):
    for row in _function(options["fetcher"])(symbol, options):
        yield tuple(row)


class NewsDays(DataSource):
    @classmethod
    def name(cls):
        return "news_days"

    def schema(self):
        return "day string, query string, ordinal int, " + ", ".join(f"{c} string" for c in ARTICLE)

    def reader(self, schema):
        from tapeline.sources.news import days_between

        days = days_between(date.fromisoformat(self.options["start"]), date.fromisoformat(self.options["end"]))
        return _Reader(self.options, [d.isoformat() for d in days], _news_rows)


class SymbolPrices(DataSource):
    @classmethod
    def name(cls):
        return "symbol_prices"

    def schema(self):
        return ", ".join(f"{c} string" for c in PRICE_COLUMNS)

    def reader(self, schema):
        from tapeline.operators.prices import canonical_symbols

        return _Reader(self.options, canonical_symbols(self.options["symbols"].split(",")), _price_rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NewsDays)
    spark.dataSource.register(SymbolPrices)
