"""Small results for people: a Markdown table, and a plot where matplotlib is installed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

WARNING = "These estimates are correlations and say nothing about causes."
COLUMNS = ("model", "horizon", "term", "coefficient", "std_error", "p_value", "n", "maxlags")


def cell(value: object) -> str:
    if value is None or value != value:
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def markdown_table(df: DataFrame, columns=COLUMNS, most: int = 10_000) -> str:
    """A table of at most `most` rows; more is an error, as it would not be read."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def write_markdown(df: DataFrame, path: str, title: str = "Regressions with robust errors") -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([f"# {title}", "", WARNING, "", markdown_table(df), ""]))


def write_event_plot(summary: DataFrame, path: str) -> bool:
    """The mean path as a PNG; False where matplotlib is not installed."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    rows = summary.orderBy("relative_day").collect()  # one per relative day
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    figure, axis = pyplot.subplots()
    axis.plot([r[0] for r in rows], [r[1] for r in rows])
    axis.axvline(0, linestyle="--")
    axis.set_xlabel("relative trading day")
    axis.set_ylabel("mean cumulative log return")
    figure.text(0.5, 0.01, WARNING, ha="center", fontsize=7)
    figure.savefig(path)
    pyplot.close(figure)
    return True
