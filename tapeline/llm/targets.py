"""Samples that match target category proportions.

Calibration: inclusion probabilities are the tilted weights d * exp(lambda . x), lambda being the root of the
dual of the entropy problem, found by Newton steps with step halving. x says in which stratum, which query type and
which category a unit is, so the margins are moments beside the categories. The moments come from one distributed
aggregation: units with equal category vectors x are one cell of a count, and the cells are sufficient for
every later iteration. Probabilities are bounded: categories that would need more than all of their units are fixed
at these, those below their minimum at that, and the rest is solved again for what is left of the sample, so the
free categories keep their target proportions to each other. Sampling: the pivotal method, in blocks of bounded size
whose last undecided units fight it out among themselves, then between the blocks, then between the categories.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.session import cut_lineage

#: Units a pivotal block holds on average; larger groups are cut into more blocks.
BLOCK = 50_000
MAX_TARGETS = 5_000


def category(value: Column) -> Column:
    """A category without letter case and outer blanks, `-` or blank as `_`; null and blank are ''."""
    trimmed = F.regexp_replace(F.lower(value), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    return F.coalesce(F.regexp_replace(trimmed, r"[-\s\p{Z}]", "_"), F.lit(""))


def tilt(cells: np.ndarray, counts: np.ndarray, totals: np.ndarray, base: float = 1.0, tolerance: float = 1e-10, steps: int = 200) -> np.ndarray:
    """lambda with sum_c counts_c * base * exp(cells_c . lambda) * cells_c = totals.

    `cells`: one category vector per cell. Targets of zero, or of cells without units, have no finite root; such
    rows should be left out. Newton on the convex dual F = sum counts * base * exp(x . lambda) - totals . lambda.
    """
    lam = np.zeros(cells.shape[1])
    value = lambda at: float((counts * base * np.exp(np.clip(cells @ at, -700, 700))).sum() - totals @ at)
    now = value(lam)
    for _ in range(steps):
        weight = counts * base * np.exp(np.clip(cells @ lam, -700, 700))
        gradient = cells.T @ weight - totals
        if np.abs(gradient).max(initial=0.0) <= tolerance * max(1.0, np.abs(totals).max(initial=0.0)):
            break
        step = np.linalg.lstsq(cells.T @ (weight[:, None] * cells), gradient, rcond=None)[0]
        scale = 1.0
        while scale > 1e-12 and not value(lam - scale * step) <= now:
            scale /= 2
        lam = lam - scale * step
        now = value(lam)
    return lam


def pivotal(pi: np.ndarray, uniforms: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Ordered pivotal sampling: who is drawn, and the one undecided unit with the probability it has left (-1: none)."""
    taken, carry, left = np.zeros(len(pi), dtype=bool), -1, 0.0
    for k, (p, u) in enumerate(zip(pi.tolist(), uniforms.tolist())):
        if p <= 0:
            continue
        if p >= 1 - 1e-12:
            taken[k] = True
        elif carry < 0:
            carry, left = k, p
        else:
            both = left + p
            if both < 1:  # one of the two drops out
                carry, left = (carry, both) if u < left / both else (k, both)
            else:  # one of the two is drawn
                rest = both - 1
                winner, loser = (carry, k) if u < (1 - p) / (2 - both) else (k, carry)
                taken[winner] = True
                carry, left = (loser, rest) if rest > 1e-9 else (-1, 0.0)
    if carry >= 0 and left > 1 - 1e-9:
        taken[carry] = True
        carry = -1
    return taken, carry, left


def unit_counts(pool: DataFrame, unit: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """(distinct (unit, category...) rows, units per category, number of units). A unit counts once per category it has."""
    units = cut_lineage(pool.select(F.col(f"`{unit}`").alias("unit"), *(category(F.col(f"`{c}`")).alias(f"cat_{k}") for k, c in enumerate(columns))).filter("unit is not null").distinct())
    keys = [f"cat_{k}" for k in range(len(columns))]
    return units, units.groupBy(*keys).agg(F.count(F.lit(1)).alias("available")), units.select("unit").distinct().count()


def moments(labels: Sequence[np.ndarray]) -> np.ndarray:
    """(cells, moments): for each margin its levels, then every cell by itself, as 0 and 1."""
    n = len(labels[0])
    return np.hstack([*(np.equal.outer(x, np.unique(x)).astype(float) for x in map(np.asarray, labels)), np.eye(n)])


def calibrate(share: np.ndarray, available: np.ndarray, floor: np.ndarray, total: float, labels: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(expected number of each cell, what holds it: `free`, `floor` or `all taken`).

    The free cells are in proportion to `share`; all together make `total`, as far as minima and what is available
    let them. Each solution is the root of the dual over the free cells; of those beyond a bound the side that is
    further beyond is fixed, and the rest is solved again.
    """
    high, x = available.astype(float), moments(labels)
    low = np.minimum(floor, high)
    held = np.where(high > 0, "free", "all taken").astype(object)
    m = np.zeros(len(high))
    while (free := held == "free").any():
        rest = max(total - m[~free].sum(), 0.0)
        goal = np.where(free, share, 0.0)
        goal = goal / goal.sum() * rest if goal.sum() > 0 else goal
        on = free & (goal > 0)
        m[free] = 0.0
        if on.any():
            base = goal[on].sum() / high[on].sum()
            m[on] = high[on] * base * np.exp(x[on] @ tilt(x[on], high[on], x[on].T @ goal[on], base=base))
        over, under = np.where(free, np.maximum(m - high, 0), 0), np.where(free, np.maximum(low - m, 0), 0)
        if max(over.max(), under.max()) <= 1e-6:
            break
        above = over.sum() >= under.sum()
        now = (over if above else under) > 1e-6
        held[now] = "all taken" if above else "floor"
        m[now] = (high if above else low)[now]
    return m, held


def allocate(pool: DataFrame, targets: DataFrame, unit: str = "pool_id", columns: Sequence[str] = ("sample_stratum", "query_type")) -> tuple[DataFrame, pd.DataFrame]:
    """(distinct units, plan). The plan has a row per row of `targets`: needed, available, met, planned, held, probability.

    needed = max(min_rows, ceil(target_pct * size / 100)), size = floor(draw_pct * units / 100); a row is met if the
    root of its needs asks for no unit with a probability above one. planned: see calibrate(), for a sample of
    size * (sum of target_pct) / 100. Rows of one category in a set are one cell, whose plan each of them shows.
    Target tables are configuration: above MAX_TARGETS rows it is an error. An empty pool leaves every positive need
    unmet; null categories match a blank target only.
    """
    columns = list(columns)
    wanted = targets.select("target_set", *columns, "target_pct", "draw_pct", "min_rows").limit(MAX_TARGETS + 1)
    units, counts, n = unit_counts(pool, unit, columns)
    keys = [f"cat_{k}" for k in range(len(columns))]
    wanted = wanted.withColumns({k: category(F.col(f"`{c}`")) for k, c in zip(keys, columns)})
    plan = wanted.join(counts, keys, "left").withColumn("available", F.coalesce("available", F.lit(0))).toPandas()
    if len(plan) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    size = (plan.draw_pct.astype("int64") * n) // 100
    plan["needed"] = np.maximum(plan.min_rows.astype("int64"), -((-plan.target_pct.astype("int64") * size) // 100))
    plan["met"], plan["planned"], plan["held"], plan["probability"] = plan.needed == 0, 0.0, "free", 0.0
    for _, rows in plan.groupby("target_set"):
        asked = rows[(rows.needed > 0) & (rows.available > 0)]
        if len(asked):
            x, have, need = moments([asked[k].to_numpy() for k in keys]), asked.available.to_numpy(float), asked.needed.to_numpy(float)
            base = need.sum() / have.sum()
            pi = base * np.exp(x @ tilt(x, have, x.T @ need, base=base))
            plan.loc[asked.index, "met"] = np.rint(pi * have) <= have
        cells = rows.groupby(keys, sort=False).agg(available=("available", "first"), share=("target_pct", "sum"), floor=("min_rows", "sum"))
        total = float(size[rows.index[0]]) * cells.share.sum() / 100
        m, held = calibrate(cells.share.to_numpy(float), cells.available.to_numpy(float), cells.floor.to_numpy(float), total, [cells.index.get_level_values(k).to_numpy() for k in keys])
        at = pd.MultiIndex.from_frame(rows[keys])
        plan.loc[rows.index, "planned"] = pd.Series(m, cells.index).reindex(at).to_numpy()
        plan.loc[rows.index, "held"] = pd.Series(held, cells.index).reindex(at).to_numpy()
        plan.loc[rows.index, "probability"] = np.minimum(1.0, plan.planned[rows.index] / plan.available[rows.index].clip(lower=1))
    return units, plan


def gaps(spark, plan: pd.DataFrame, columns: Sequence[str] = ("sample_stratum", "query_type")) -> DataFrame:
    """The rows of the targets that can't be met, as written there."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("target_set", *columns)])
    return spark.createDataFrame(plan.loc[~plan.met, ["target_set", *columns]].drop_duplicates().values.tolist(), schema)


def draw(units: DataFrame, plan: pd.DataFrame, columns: Sequence[str] = ("sample_stratum", "query_type"), seed: int = 1) -> DataFrame:
    """(target_set, columns..., unit): the sample. Every category gets its planned number of units, rounded up or down, and a set the sum of them.

    Each (set, category) is cut by a hash of the unit into blocks of about BLOCK units, so a category with a third of
    all rows is many tasks; what a block leaves undecided (one unit at most) goes to a second round, which has a unit
    a block, and what a category leaves undecided to a third, which has a unit a category.
    """
    spark, keys = units.sparkSession, [f"cat_{k}" for k in range(len(columns))]
    live = plan[plan.planned > 0].drop_duplicates(["target_set", *keys]).copy()
    live["blocks"] = (live.available // BLOCK + 1).astype("int64")
    schema = "target_set string, " + ", ".join(f"{k} string, `as_{k}` string" for k in keys) + ", pi double, blocks long"
    rows = [[r.target_set, *(x for k, c in zip(keys, columns) for x in (getattr(r, k), getattr(r, c))), float(r.probability), int(r.blocks)] for r in live.itertuples()]
    chosen = F.broadcast(spark.createDataFrame(rows, schema))  # MAX_TARGETS rows at most
    one = units.join(chosen, keys).withColumn("block", F.pmod(F.xxhash64("unit", F.lit(seed)), F.col("blocks")))
    names = ["target_set", *(f"as_{k}" for k in keys)]
    out = T.StructType([*(T.StructField(c, T.StringType()) for c in names), T.StructField("unit", one.schema["unit"].dataType), T.StructField("pi", T.DoubleType()), T.StructField("state", T.IntegerType())])

    def fight(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(pdf.order.iloc[0]) & 0x7FFFFFFF])
        taken, carry, left = pivotal(pdf.pi.to_numpy(), rng.random(len(pdf)))
        pdf["state"] = taken.astype("int32")
        if carry >= 0:
            pdf.loc[carry, "state"], pdf.loc[carry, "pi"] = 2, left
        return pdf.loc[pdf.state > 0, [*names, "unit", "pi", "state"]]

    ordered = one.withColumn("order", F.xxhash64("unit", "target_set", F.lit(seed + 1)))
    first = cut_lineage(ordered.select(*names, "unit", "pi", "order", "block").groupBy(*names, "block").applyInPandas(fight, out))
    again = lambda rows: rows.filter("state = 2").withColumn("order", F.xxhash64("unit", "target_set", F.lit(seed + 1)))
    second = cut_lineage(again(first).groupBy(*names).applyInPandas(fight, out))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        done = fight(pdf)
        done.loc[done.state == 2, "state"] = (done.pi[done.state == 2] >= 0.5).astype("int32")  # the set's sum is whole but for rounding
        return done[done.state == 1]

    third = again(second).groupBy("target_set").applyInPandas(last, out)
    drawn = first.filter("state = 1").unionByName(second.filter("state = 1")).unionByName(third)
    return drawn.select("target_set", *(F.col(f"as_{k}").alias(c) for k, c in zip(keys, columns)), "unit")


def plan_frame(spark, plan: pd.DataFrame, columns: Sequence[str] = ("sample_stratum", "query_type")) -> DataFrame:
    """(target_set, columns..., target_pct, needed, available, planned, held) of every target row."""
    kinds = ", ".join(f"`{c}` string" for c in ("target_set", *columns))
    rows = [[r.target_set, *(getattr(r, c) for c in columns), int(r.target_pct), int(r.needed), int(r.available), float(r.planned), r.held] for r in plan.itertuples()]
    return spark.createDataFrame(rows, f"{kinds}, target_pct int, needed long, available long, planned double, held string")


def shares(units: DataFrame, plan: pd.DataFrame, columns: Sequence[str] = ("sample_stratum", "query_type"), seed: int = 1) -> DataFrame:
    """(target_set, columns..., target_pct, actual_pct, planned, drawn, held): what the drawn sample holds against its targets."""
    by = ["target_set", *columns]
    got = draw(units, plan, columns, seed).groupBy(*by).agg(F.count(F.lit(1)).alias("drawn"))
    rows = plan_frame(units.sparkSession, plan, columns).join(got, by, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    whole = got.groupBy("target_set").agg(F.sum("drawn").alias("all"))
    return rows.join(whole, "target_set", "left").select(*by, "target_pct", F.round(F.col("drawn") * 100 / F.col("all"), 4).alias("actual_pct"), F.round("planned", 4).alias("planned"), "drawn", "held")


__all__ = ["allocate", "calibrate", "category", "draw", "gaps", "pivotal", "plan_frame", "shares", "tilt"]
