"""Consensus from several annotators' labels by message passing on the graph of label edges.

One class against the rest: an edge says whether an annotator put an item into the class. Items tell annotators
how likely they are in the class, judged by everyone else; annotators tell items how much their word weighs,
judged by all of their other items: how often they say yes inside the class and no outside of it. Who always
says the same weighs nothing, who says the contrary counts the other way round. Messages run to convergence.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.targets import category
from tapeline.plans.groups import attach
from tapeline.session import cut_lineage

CATEGORIES = ("valuation", "bubble_speculation", "crash_correction_warning", "ai_tech_hype", "concentration")
#: Prior counts of an annotator's hits and misses, in and out of the class.
PRIOR_HIT, PRIOR_MISS = 4.0, 1.0
MAX_ROUNDS = 300
#: Messages have converged when none of them moves by more than this any more.
TOLERANCE = 1e-2
#: Rounds between two writes of the messages, and edges of a partition.
WRITE_EVERY = 5
PARTITION_EDGES = 500_000
#: Groups beyond this many rows join back through attach(); so many annotators at most are broadcast.
LARGE_GROUP = 100_000
FEW = 50_000


def one_each(labels: DataFrame, label_id: str = "label_id", item: str = "id", annotator: str = "annotator") -> DataFrame:
    """Of each (item, annotator) the row with the smallest label id; rows without either are left out."""
    keep = [c for c in labels.columns if c not in (item, annotator)]
    rows = labels.filter(F.col(item).isNotNull() & F.col(annotator).isNotNull() & F.col(label_id).isNotNull())
    first = rows.groupBy(item, annotator).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in keep)), F.col(label_id)).alias("_r"))
    return first.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), *(F.col("_r").getField(c).alias(c) for c in keep if c not in ("item", "annotator")))


def binary(label: Column) -> Column:
    """0 or 1 apart from outer blanks, else null."""
    inner = F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    return F.when(inner.isin("0", "1"), inner.cast("int"))


class NotConverged(RuntimeError):
    """Messages that still move after the last round."""


def _heard(p: np.ndarray, said: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What annotators tell items, by the sums (n, 4) of the annotator of each edge, the edge's own part taken off."""
    hit = (of[:, 1] - p * said + PRIOR_HIT) / (of[:, 0] - p + PRIOR_HIT + PRIOR_MISS)
    calm = (of[:, 3] - (1 - p) * (1 - said) + PRIOR_HIT) / (of[:, 2] - (1 - p) + PRIOR_HIT + PRIOR_MISS)
    return np.where(said == 1, np.log(hit / (1 - calm)), np.log((1 - hit) / calm))


class _Part:
    """The edges of a partition, all edges of an item side by side, and rounds over them."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        rows = pd.concat(list(batches), ignore_index=True)  # PARTITION_EDGES or so
        self.rows, self.said, self.weight = rows, rows["said"].to_numpy(), rows["weight"].to_numpy(float)
        self.cls, self.who = rows["cls"].to_numpy(), rows["who"].to_numpy()
        new = np.r_[True, (self.cls[1:] != self.cls[:-1]) | (rows["item"].to_numpy()[1:] != rows["item"].to_numpy()[:-1])] if len(rows) else np.zeros(0, bool)
        self.start, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        self.moved = np.zeros(len(rows))

    def inside(self) -> np.ndarray:
        """How likely each item is in the class, by everyone but the edge's own annotator."""
        total = np.add.reduceat(self.weight, self.start) if len(self.start) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(total[self.group] - self.weight, -700, 700)))

    def replay(self, sums: list[np.ndarray]) -> None:
        for of in sums:
            new = _heard(self.inside(), self.said, of[self.cls, self.who])
            self.moved, self.weight = np.abs(new - self.weight), new


def intensity_value(score: Column) -> Column:
    """The number of an intensity score, outer blanks and a decimal comma allowed, else null."""
    return F.replace(F.regexp_replace(score, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", ""), F.lit(","), F.lit(".")).try_cast("double")


def pass_messages(edges: DataFrame, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(cls, item, log_odds) for edges (cls, item, annotator, said), said being 0 or 1, one per (cls, item, annotator).

    The edges are shuffled once, by item. A round is a narrow pass over them: items speak inside their partition, and
    of the annotators only four sums each are put together and sent back, FEW annotators at most. Partitions replay
    the rounds since the messages were last written to the checkpoint folder. More annotators take pass_by_joins().
    Messages that still move by more than `tolerance` after `rounds` raise NotConverged. An empty table gives none.
    """
    edges = edges.select("cls", "item", "annotator", "said")
    names = [r[0] for r in edges.select("annotator").distinct().limit(FEW + 1).collect()]
    if len(names) > FEW:
        return pass_by_joins(edges, rounds, tolerance)
    spark = edges.sparkSession
    kinds = sorted(r[0] for r in edges.select("cls").distinct().collect())  # one, or the categories
    coded = edges.join(F.broadcast(spark.createDataFrame([*enumerate(sorted(names))], "who int, annotator string")), "annotator")
    coded = coded.join(F.broadcast(spark.createDataFrame([*enumerate(kinds)], "k int, cls string")), "cls")
    parts = max(spark.sparkContext.defaultParallelism, edges.count() // PARTITION_EDGES + 1)
    schema = "cls int, item string, who int, said int, weight double"
    state = coded.select(F.col("k").alias("cls"), "item", "who", F.col("said").cast("int").alias("said"), F.when(F.col("said") == 1, 1.0).otherwise(-1.0).alias("weight"))
    state = cut_lineage(state.repartition(parts, "cls", "item").sortWithinPartitions("cls", "item"))
    since: list[np.ndarray] = []
    most = np.inf
    for _ in range(rounds if names else 0):
        held = spark.sparkContext.broadcast(since)  # a few rounds of four numbers per annotator and class

        def sums(batches, held=held):
            if (first := next(batches, None)) is None:
                return
            part = _Part(itertools.chain([first], batches))
            part.replay(held.value)
            p = part.inside()
            rows = pd.DataFrame({"cls": part.cls, "who": part.who, "a": p, "b": p * part.said, "c": 1 - p, "d": (1 - p) * (1 - part.said), "moved": part.moved})
            yield rows.groupby(["cls", "who"], as_index=False).agg({"a": "sum", "b": "sum", "c": "sum", "d": "sum", "moved": "max"})

        got = state.mapInPandas(sums, "cls int, who int, a double, b double, c double, d double, moved double").groupBy("cls", "who").agg(*(F.sum(c).alias(c) for c in "abcd"), F.max("moved").alias("moved")).collect()
        held.destroy()
        most = max((r.moved for r in got), default=0.0)
        if since and most <= tolerance:
            break
        of = np.zeros((len(kinds), len(names), 4))
        for r in got:
            of[r.cls, r.who] = r.a, r.b, r.c, r.d
        since.append(of)
        if len(since) > WRITE_EVERY:
            state = cut_lineage(_replayed(state, since[:-1], schema))
            since = since[-1:]
    else:
        if names:
            raise NotConverged(f"messages still move by {most:.4f} after {rounds} rounds")
    known = spark.createDataFrame([*enumerate(kinds)], "k int, cls string")
    out = _replayed(state, since, schema).groupBy(F.col("cls").alias("k"), "item").agg(F.sum("weight").alias("log_odds"))
    return out.join(F.broadcast(known), "k").select("cls", "item", "log_odds")


def _replayed(state: DataFrame, sums: list[np.ndarray], schema: str) -> DataFrame:
    def weights(batches):
        if (first := next(batches, None)) is not None:
            part = _Part(itertools.chain([first], batches))
            part.replay(sums)
            yield part.rows.assign(weight=part.weight)

    return state.mapInPandas(weights, schema)


def pass_by_joins(edges: DataFrame, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """pass_messages() for any number of annotators.

    Sums per item and per annotator are aggregated map-side and joined back, so a hot item or annotator is never
    in one task. After each round the messages are written to the shared checkpoint folder. An empty table gives none.
    """
    edges = edges.select("cls", "item", "annotator", "said")
    shape = edges.groupBy("cls", "item").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    few = edges.select("cls", "annotator").distinct().limit(FEW + 1).count() <= FEW

    def back(rows: DataFrame, groups: DataFrame, keys: list[str], small: bool, narrow: bool) -> DataFrame:
        if small:
            return rows.join(F.broadcast(groups), keys)  # FEW rows, counted above
        return rows.join(groups, keys) if narrow else attach(rows, groups.persist(StorageLevel.MEMORY_AND_DISK), keys, "n")

    state = cut_lineage(edges.withColumn("weight", F.when(F.col("said") == 1, 1.0).otherwise(-1.0)))
    in_class, out_class = F.col("p"), 1 - F.col("p")
    for _ in range(rounds):
        sums = state.groupBy("cls", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))
        told = back(state, sums, ["cls", "item"], False, shape <= LARGE_GROUP).withColumn("p", 1 / (1 + F.exp(-(F.col("total") - F.col("weight"))))).drop("total", "n").persist(StorageLevel.MEMORY_AND_DISK)
        of = told.groupBy("cls", "annotator").agg(
            F.count(F.lit(1)).alias("n"), F.sum(in_class).alias("inside"), F.sum(in_class * F.col("said")).alias("yes_inside"), F.sum(out_class).alias("outside"), F.sum(out_class * (1 - F.col("said"))).alias("no_outside")
        )
        heard = back(told, of, ["cls", "annotator"], few, False)
        hit = (F.col("yes_inside") - in_class * F.col("said") + PRIOR_HIT) / (F.col("inside") - in_class + PRIOR_HIT + PRIOR_MISS)
        calm = (F.col("no_outside") - out_class * (1 - F.col("said")) + PRIOR_HIT) / (F.col("outside") - out_class + PRIOR_HIT + PRIOR_MISS)
        new = F.when(F.col("said") == 1, F.log(hit / (1 - calm))).otherwise(F.log((1 - hit) / calm))
        after = cut_lineage(heard.select("cls", "item", "annotator", "said", new.alias("weight"), F.abs(new - F.col("weight")).alias("moved")))
        moved = after.agg(F.max("moved")).first()[0]
        told.unpersist()
        state = after.drop("moved")
        if moved is None or moved <= tolerance:
            break
    else:
        raise NotConverged(f"messages still move by {moved:.4f} after {rounds} rounds")
    return state.groupBy("cls", "item").agg(F.sum("weight").alias("log_odds"))


def label_rows(labels: DataFrame) -> DataFrame:
    """(item, annotator, said, category, intensity_score) of the one row of each (item, annotator); said is null where it is not usable."""
    return one_each(labels).select("item", "annotator", binary(F.col("criticism_label")).alias("said"), category(F.col("category_label")).alias("category"), F.col("intensity_score"))


def consensus(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, usable labels) of label rows with criticism_label and category_label.

    items: item, yes, no (usable labels), truth (0 or 1), log_odds, category, category_log_odds. Ties are 0 in truth
    and the first by name in category. An item whose truth is 1 but that has no usable category keeps a null one.
    """
    usable = cut_lineage(label_rows(labels).filter("said is not null"))
    truth = pass_messages(usable.select(F.lit("criticism").alias("cls"), "item", "annotator", "said"))
    counts = usable.groupBy("item").agg(F.sum("said").alias("yes"), F.sum(1 - F.col("said")).alias("no"))
    items = cut_lineage(counts.join(truth.drop("cls"), "item").withColumn("truth", (F.col("log_odds") > 0).cast("int")))
    named = usable.filter("said = 1").filter(F.col("category").isin(*CATEGORIES)).join(items.filter("truth = 1").select("item"), "item", "left_semi")
    each = named.select("item", "annotator", "category", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("cls")).select("cls", "item", "annotator", (F.col("cls") == F.col("category")).cast("int").alias("said"))
    odds = pass_messages(each)
    best = odds.groupBy("item").agg(F.max_by(F.struct(F.col("cls").alias("category"), F.col("log_odds").alias("category_log_odds")), F.struct("log_odds", F.hash("cls"))).alias("b"))
    return items.join(best.select("item", "b.*"), "item", "left"), usable


def reliability(usable: DataFrame, items: DataFrame) -> DataFrame:
    """(annotator, labels, agreeing, reliability, unreliable): the share of an annotator's labels that are the true ones."""
    both = usable.join(items.select("item", "truth"), "item")
    out = both.groupBy("annotator").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("said") == F.col("truth")).alias("agreeing"))
    return out.withColumn("reliability", F.col("agreeing") / F.col("labels")).withColumn("unreliable", F.col("agreeing") * 3 < F.col("labels") * 2)


def answers(items: DataFrame, annotators: DataFrame) -> DataFrame:
    """(subject, subject_key, answer): disputed items with 0 or their category, and unreliable annotators."""
    disputed = items.filter("yes > 0 and no > 0").select(F.lit("item").alias("subject"), F.col("item").alias("subject_key"), F.when(F.col("truth") == 1, F.col("category")).otherwise("0").alias("answer"))
    return disputed.unionByName(annotators.filter("unreliable").select(F.lit("annotator").alias("subject"), F.col("annotator").alias("subject_key"), F.lit("unreliable").alias("answer")))


def agreement(usable: DataFrame) -> DataFrame:
    """(field, items, pairs, observed, alpha): pairwise agreement and Krippendorff's nominal alpha of each field.

    `usable` are rows of label_rows(); each field counts where it is usable itself, whatever the others hold.
    """
    score = intensity_value(F.col("intensity_score"))
    long = usable.select("item", F.explode(F.array(
        F.struct(F.lit("criticism_label").alias("field"), F.col("said").cast("string").alias("value")),
        F.struct(F.lit("category_label").alias("field"), F.when(F.col("category").isin(*CATEGORIES), F.col("category")).alias("value")),
        F.struct(F.lit("intensity_score").alias("field"), F.when((score >= 0) & (score <= 3), score.cast("string")).alias("value")),
    )).alias("v")).select("item", "v.*").filter("value is not null")
    each = long.groupBy("field", "item", "value").agg(F.count(F.lit(1)).alias("c"))
    by_item = each.groupBy("field", "item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).filter("n > 1")
    paired = each.join(by_item.select("field", "item"), ["field", "item"], "left_semi").groupBy("field", "value").agg(F.sum("c").alias("c"))
    expected = paired.groupBy("field").agg(F.sum("c").alias("total"), F.sum(F.col("c") * (F.col("c") - 1)).alias("like"))
    seen = by_item.groupBy("field").agg(F.count(F.lit(1)).alias("items"), (F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("long").alias("pairs"), (F.sum("same") / F.sum(F.col("n") * (F.col("n") - 1))).alias("observed"), F.sum(F.col("same") / (F.col("n") - 1)).alias("o"))
    by_chance = F.col("like") / (F.col("total") * (F.col("total") - 1))
    return seen.join(expected, "field").select("field", "items", "pairs", "observed", F.when(by_chance < 1, (F.col("o") / F.col("total") - by_chance) / (1 - by_chance)).alias("alpha"))


def intensity(usable: DataFrame, items: DataFrame, annotators: DataFrame) -> DataFrame:
    """(item, intensity): the median of usable scores (0 to 3) of positive items, each as heavy as its annotator is reliable."""
    score = intensity_value(F.col("intensity_score"))
    rows = usable.filter("said = 1").withColumn("score", score).filter("score between 0 and 3").join(items.filter("truth = 1").select("item"), "item", "left_semi").join(annotators.select("annotator", "reliability"), "annotator")
    by = Window.partitionBy("item").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.groupBy("item", "score").agg(F.sum("reliability").alias("w"))
    ranked = merged.withColumn("upto", F.sum("w").over(by)).withColumn("all", F.sum("w").over(Window.partitionBy("item")))
    return ranked.filter("upto * 2 >= all").groupBy("item").agg(F.min("score").alias("intensity"))
