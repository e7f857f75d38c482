"""Shared settings. The lists are fixed values: the results depend on them."""

from __future__ import annotations

from datetime import date

START_DATE, END_DATE = date(2022, 1, 1), date(2026, 5, 31)
MARKET_TERMS = ("US stock market", "Wall Street", "S&P 500", "Nasdaq", "US equities", "American stocks")
CRITICISM_TERMS = (
    "overvalued", "expensive", "bubble", "mania", "crash", "correction", "selloff", "fragile", "frothy", "speculative",
    "concentration risk", "AI bubble", "Magnificent Seven",
)
CATEGORIES = ("valuation", "bubble_speculation", "crash_correction_warning", "ai_tech_hype", "concentration")
STRATA = ("likely_criticism", "general_market", "ambiguous")
VIX = "^VIX"
SYMBOLS = ("SPY", "QQQ", "RSP", VIX)
ETFS = ("SPY", "QQQ", "RSP")
ALL_MARKET, CANDIDATE = "all_us_market", "candidate_criticism"
ARTICLE_FIELDS = ("title", "url", "domain", "source", "seendate", "language", "query_type")
LABEL_COLUMNS = ("market_relevant_label", "criticism_label", "category_label", "intensity_score", "annotator_notes")
ANNOTATION_COLUMNS = ("id", "date", "title", "source", "domain", "url", "query_type", "sample_stratum", *LABEL_COLUMNS)
PRICE_COLUMNS = ("date", "symbol", "open", "high", "low", "close", "adj_close", "volume")
HORIZONS = (1, 5, 21)
VOL_WINDOW = 21
ROLLING_WINDOW = 60
