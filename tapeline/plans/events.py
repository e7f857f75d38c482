"""Event study: mean cumulative return around the days of the index's top decile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.checks import CheckError, require_columns


def positions(panel: DataFrame, index_column: str, returns: str = "spy_fwd_log_return_1d") -> DataFrame:
    """(position, date, z, f, s, holes): rows of the panel in order with prefix sums of returns and of missing ones."""
    require_columns(panel, ("date", index_column, returns), "event study")
    clean = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    rows = panel.select("date", clean(index_column).alias("z"), clean(returns).alias("f"))
    order = Window.orderBy("date")  # a panel has one row per day
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        (F.row_number().over(order) - 1).alias("position"), "date", "z", "f",
        F.coalesce(F.sum("f").over(before), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("f").isNull().cast("int")).over(before), F.lit(0)).alias("holes"),
    )


def event_days(rows: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Rows at or above the exact, linearly interpolated quantile of the non-missing values."""
    threshold = rows.agg(F.percentile("z", quantile).alias("threshold"))
    return rows.join(F.broadcast(threshold), F.col("z") >= F.col("threshold")).drop("threshold")  # threshold: one row


def event_paths(rows: DataFrame, window: tuple[int, int] = (-10, 21), quantile: float = 0.9) -> DataFrame:
    """(event, relative_day, path) of the complete events; an event with a missing return in its window is dropped."""
    low, high = window
    if low >= 0 or high <= 0:
        raise CheckError("the event window must reach from before to after the event")
    events = event_days(rows, quantile).select(F.col("position").alias("event"), F.col("s").alias("s0"))
    # the sums up to e + r are read at row e + r: an equi-join, a row per (event, relative day)
    wanted = events.select("event", "s0", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("relative_day")).withColumn("position", F.col("event") + F.col("relative_day"))
    met = wanted.join(rows.select("position", "s", "holes"), "position")
    whole = met.groupBy("event").agg(F.count(F.lit(1)).alias("n"), (F.max("holes") - F.min("holes")).alias("gaps")).filter((F.col("n") == high - low + 1) & (F.col("gaps") == 0))
    return met.join(whole.select("event"), "event", "left_semi").select("event", "relative_day", (F.col("s") - F.col("s0")).alias("path"))


def event_study(panel: DataFrame, index_column: str, window: tuple[int, int] = (-10, 21), quantile: float = 0.9, returns: str = "spy_fwd_log_return_1d") -> DataFrame:
    """(relative_day, average_cumulative_spy_log_return, event_count), ordered."""
    paths = event_paths(positions(panel, index_column, returns), window, quantile)
    return paths.groupBy("relative_day").agg(F.avg("path").alias("average_cumulative_spy_log_return"), F.count(F.lit(1)).alias("event_count")).orderBy("relative_day")


def checked_event_study(panel: DataFrame, index_column: str, window: tuple[int, int] = (-10, 21)) -> tuple[DataFrame, int, int]:
    """(summary, complete events, dropped events); an error if no event is complete."""
    rows = positions(panel, index_column)
    if not rows.filter("z is not null").limit(1).count():
        raise CheckError("the event study needs a non-missing index value")
    total = event_days(rows).count()
    summary = event_study(panel, index_column, window)
    first = summary.limit(1).collect()
    if not first:
        raise CheckError("no complete event window")
    return summary, first[0]["event_count"], total - first[0]["event_count"]
