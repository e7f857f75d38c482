"""Command lines: python -m tapeline.cli.main COMMAND ... Each returns 1 with a message on expected errors."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import date

from pyspark.errors import PySparkException

from tapeline.config import ALL_MARKET, CANDIDATE, END_DATE, HORIZONS, ROLLING_WINDOW, START_DATE, SYMBOLS
from tapeline.session import build_session


def _day(text: str) -> date:
    return date.fromisoformat(text)


def _numbered(spark, path):
    from pyspark.sql import functions as F

    from tapeline.io import read_text_csv

    return read_text_csv(spark, path).withColumn("_row", F.monotonically_increasing_id())


def _collect_news(a, spark):
    from tapeline.sources import http, news

    types = {"all-market": (ALL_MARKET,), "candidates": (CANDIDATE,), "both": (ALL_MARKET, CANDIDATE)}[a.query_type]
    spec = news.RunSpec(a.raw_dir, a.interim_dir, a.endpoint, a.start_date, a.end_date, types, a.max_records, overwrite_interim=a.overwrite)
    if a.dry_run:
        news.dry_run(news.run_status(spark, spec), spec.pause_seconds).show(truncate=False)
        return
    results = news.collect(spark, spec, http.Retrying(http.urllib_transport()), lambda e: print(e, file=sys.stderr))
    for k, v in news.totals(results).items():
        print(f"{k}: {v}")


def _collect_prices(a, spark):
    from tapeline.sources import http, market

    symbols = tuple(s for part in a.symbols for s in part.split(",") if s.strip())
    spec = market.PriceSpec(a.endpoint, a.raw_output_dir, a.start_date, a.end_date, symbols, a.max_retries, pause_seconds=a.request_pause_seconds)
    if a.preflight:
        print(f"rows: {market.preflight(spec, http.urllib_transport())}")
        return
    path, rows = market.collect_prices(spark, spec, http.urllib_transport())
    print(f"{path}: {rows.count()} rows")


def _clean(a, spark):
    from tapeline.io import read_text_csv, write_csv
    from tapeline.operators import headlines

    rows = _numbered(spark, a.input)
    calendar = read_text_csv(spark, a.calendar) if a.calendar else None
    cleaned = headlines.clean_headlines(rows, calendar, a.text_column, strict=calendar is not None)
    kept = headlines.dedupe_fuzzy(cleaned, "_row") if a.fuzzy else headlines.dedupe_exact(cleaned, "_row") if not a.keep_all else cleaned
    write_csv(kept.orderBy("_row").drop("_row"), a.output, a.overwrite, a.raw_dir)


def _sample(a, spark):
    from tapeline.io import guard_output, write_csv
    from tapeline.operators import annotate

    path = a.output_path or os.path.join(a.output_dir, f"annotation_sample_{a.run_date:%Y%m%d}_seed{a.seed}.csv")
    guard_output(path, a.overwrite, a.raw_dir)
    pool = annotate.strata(_numbered(spark, a.candidate_csv), _numbered(spark, a.all_market_csv), "_row")
    counts = {"likely_criticism": a.likely_count, "general_market": a.general_count, "ambiguous": a.ambiguous_count}
    rows, short = annotate.sample(pool, annotate.SampleSpec(counts, a.seed))
    write_csv(rows, path, a.overwrite, a.raw_dir)
    for k, v in short.items():
        print(f"{k}: {counts[k] - v} rows, {v} short")


def _validate(a, spark):
    from pyspark.sql import functions as F

    from tapeline.io import label_files, read_text_csv
    from tapeline.operators import annotate

    files = a.file or ([] if a.allow_empty and not (os.path.isdir(a.labelled_dir) and os.listdir(a.labelled_dir)) else label_files(a.labelled_dir))
    if not files:
        print("no labelled files")
        return
    rows = None
    for f in files:
        part = read_text_csv(spark, f).withColumn("_annotation_file", F.lit(f))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    print(annotate.format_report(annotate.validation_report(rows.withColumn("_row", F.monotonically_increasing_id()), "_row", "_annotation_file")))


def _index(a, spark):
    from tapeline.io import guard_output, read_label_union, write_csv
    from tapeline.operators import index

    guard_output(a.output, a.overwrite, a.raw_dir)
    market, candidates = _numbered(spark, a.market_csv), _numbered(spark, a.criticism_csv)
    for df, name in ((market, "market"), (candidates, "candidates")):
        index.require_days(df, "_row", name)
    labels = None
    if a.labels:
        from pyspark.sql import functions as F

        labels = read_label_union(spark, a.labels).withColumn("_row", F.monotonically_increasing_id())
        index.require_days(labels, "_row", "labels")
        labels = index.with_day(labels)
    matched = index.match_labels(index.with_day(candidates), labels, "_row")
    write_csv(index.daily_index(index.with_day(market), matched, a.rolling_window, a.index_name), a.output, a.overwrite, a.raw_dir)


def _panel(a, spark):
    from pyspark.sql import functions as F

    from tapeline.io import guard_output, read_text_csv, write_csv
    from tapeline.operators import index, prices

    guard_output(a.output, a.overwrite, a.raw_dir)
    daily = _numbered(spark, a.index_csv)
    index.require_days(daily, "_row", "index", ("date",))
    daily = index.with_day(daily, ("date",)).drop("_row").withColumn("date", F.col("day")).drop("day")
    panel = prices.build_panel(daily, prices.checked_prices(_numbered(spark, a.prices_csv), "_row"), SYMBOLS)
    write_csv(panel, a.output, a.overwrite, a.raw_dir)
    out = read_text_csv(spark, a.output)
    print(f"{out.count()} rows, {len(out.columns)} columns")


def _analysis(a, spark):
    from tapeline.io import guard_output, read_text_csv, write_csv
    from tapeline.operators import index
    from tapeline.plans import events, regress, report
    from tapeline.session import cut_lineage

    paths = [os.path.join(a.tables_dir, n) for n in ("event_study.csv", "baseline_regressions.csv", "baseline_regressions.md")] + [os.path.join(a.figures_dir, "event_study.png")]
    for p in paths:
        guard_output(p, a.overwrite)
    rows = _numbered(spark, a.panel_csv)
    index.require_days(rows, "_row", "panel", ("date",))
    panel = cut_lineage(read_text_csv(spark, a.panel_csv))
    z = f"{a.index_name}_rolling_{a.rolling_window}d_zscore"
    summary, complete, dropped = events.checked_event_study(panel, z)
    table = regress.regressions(spark, panel, z, HORIZONS)  # everything is computed before anything is written
    write_csv(summary, paths[0], a.overwrite)
    write_csv(table, paths[1], a.overwrite)
    report.write_markdown(table, paths[2])
    report.write_event_plot(summary, paths[3])
    print(f"{complete} events, {dropped} dropped; {table.count()} regression rows")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tapeline")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, run):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--overwrite", action="store_true")
        c.add_argument("--raw-dir", default="data/raw")
        return c

    c = add("collect-news", _collect_news)
    c.add_argument("--query-type", choices=("all-market", "candidates", "both"), default="both")
    c.add_argument("--endpoint", required=True)
    c.add_argument("--interim-dir", default="data/interim")
    c.add_argument("--max-records", type=int, default=250)
    c.add_argument("--dry-run", action="store_true")
    p = add("collect-prices", _collect_prices)
    p.add_argument("--endpoint", required=True)
    p.add_argument("--symbols", nargs="+", default=list(SYMBOLS))
    p.add_argument("--raw-output-dir", default="data/raw/market")
    p.add_argument("--max-retries", type=int, default=5)
    p.add_argument("--request-pause-seconds", type=float, default=5.0)
    p.add_argument("--preflight", action="store_true")
    for x in (c, p):
        x.add_argument("--start-date", type=_day, default=START_DATE)
        x.add_argument("--end-date", type=_day, default=END_DATE)
    c = add("clean-headlines", _clean)
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--text-column", default="title")
    c.add_argument("--calendar")
    c.add_argument("--fuzzy", action="store_true")
    c.add_argument("--keep-all", action="store_true")
    c = add("annotation-sample", _sample)
    for x in ("candidate-csv", "all-market-csv"):
        c.add_argument(f"--{x}", required=True)
    c.add_argument("--output-path")
    c.add_argument("--output-dir", default="data/annotation")
    for x, n in (("likely", 200), ("general", 200), ("ambiguous", 100)):
        c.add_argument(f"--{x}-count", type=int, default=n)
    c.add_argument("--seed", type=int, default=1)
    c.add_argument("--run-date", type=_day, default=date.today())
    c = add("validate-annotations", _validate)
    c.add_argument("--labelled-dir", default="data/annotation/labelled")
    c.add_argument("--file", action="append")
    c.add_argument("--allow-empty", action="store_true")
    c = add("build-index", _index)
    c.add_argument("--market-csv", required=True)
    c.add_argument("--criticism-csv", required=True)
    c.add_argument("--labels")
    c.add_argument("--output", required=True)
    c.add_argument("--rolling-window", type=int, default=ROLLING_WINDOW)
    c.add_argument("--index-name", default="narrative_index")
    c = add("build-panel", _panel)
    c.add_argument("--prices-csv", required=True)
    c.add_argument("--index-csv", required=True)
    c.add_argument("--output", required=True)
    c = add("run-analysis", _analysis)
    c.add_argument("--panel-csv", required=True)
    c.add_argument("--figures-dir", default="outputs/figures")
    c.add_argument("--tables-dir", default="outputs/tables")
    c.add_argument("--rolling-window", type=int, default=ROLLING_WINDOW)
    c.add_argument("--index-name", default="narrative_index")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(a, build_session())
    except (ValueError, OSError, RuntimeError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
