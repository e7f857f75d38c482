"""Mixing sources to target weights.

Each source gets its share of the budget as certain whole copies of all of its documents plus a fixed-size
sample for what is left. The sample is Pareto's order sampling: documents are ranked by random odds over
inclusion odds, inclusion being proportional to size in tokens and never above one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.session import cut_lineage

TOKENIZERS = os.environ.get("TAPELINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The splitting pattern that goes with the byte-level vocabulary: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MAX_TARGETS = 100_000
#: Slices of the rank scale in which the sample's limit is looked for.
SLICES = 1 << 16


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of a text by a public byte-level tokenizer; null and empty texts have none.

    `path`: its vocabulary file on the driver, which is sent to the executors.
    """
    file = path or os.path.join(TOKENIZERS, VOCABULARY)
    SparkSession.active().sparkContext.addFile(file)
    name = os.path.basename(file)

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([0 if t is None else len(encoding.encode_ordinary(t)) for t in batch], dtype="int64")

    return tokens(text)


def source_key(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", ""))


def measured(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(doc_id, key, tokens) of every document, written: the texts are read and tokenised once."""
    return cut_lineage(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), source_key(F.col(f"`{source}`")).alias("key"), count_tokens(F.col(f"`{text}`"), path).alias("tokens")))


def _slope(sizes: pd.DataFrame, wanted: float) -> float:
    """k with sum of n * t * min(1, k * t) = wanted over sizes (t, n)."""
    t, n = sizes.tokens.to_numpy(float), sizes.n.to_numpy(float)
    low, high = 0.0, 1.0 / max(t.min(initial=1.0), 1.0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * t * np.minimum(1.0, mid * t)).sum() < wanted else (low, mid)
    return high


def plan_mixtures(sizes: DataFrame, targets: DataFrame) -> pd.DataFrame:
    """One row per row of `targets`: wanted and available tokens, certain copies, what the sample adds, met.

    Integer arithmetic decides `met`: available * max_repeats * 10000 >= target_pct * budget_pct * all tokens.
    """
    by_source = sizes.groupBy("key").agg(F.sum("tokens").alias("available"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    wanted = targets.select("mix_id", "source", "target_pct", "max_repeats", "budget_pct").limit(MAX_TARGETS + 1).withColumn("key", source_key(F.col("source")))
    plan = wanted.join(by_source, "key", "left").withColumn("available", F.coalesce("available", F.lit(0))).toPandas()
    if len(plan) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    share = [int(a) * int(b) * int(total) for a, b in zip(plan.target_pct, plan.budget_pct)]
    plan["met"] = [int(a) * int(r) * 10000 >= s for a, r, s in zip(plan.available, plan.max_repeats, share)]
    plan["wanted"] = [s / 10000 for s in share]
    reach = np.minimum(plan.wanted, plan.available * plan.max_repeats)
    plan["whole"] = np.where(plan.available > 0, np.minimum(reach // plan.available.clip(lower=1), plan.max_repeats), 0).astype("int64")
    plan["rest"] = np.where(plan.met, reach - plan.whole * plan.available, 0.0)
    return plan


def shortfalls(spark, plan: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(plan.loc[~plan.met, ["mix_id", "source"]].drop_duplicates().values.tolist(), "mix_id string, source string")


def mix(sizes: DataFrame, plan: pd.DataFrame, seed: int = 1) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies): the mixture, documents with at least one copy.

    The sample has a fixed size per (mixture, source); its limit on the rank scale is found by a histogram, and
    only the documents of the one slice that holds the limit are ranked, so no source is ever sorted in one task.
    Documents without tokens take no part; ties of the random ranks are broken by doc_id.
    """
    spark = sizes.sparkSession
    documents = sizes.filter("tokens > 0")
    rows = [[r.mix_id, r.source, r.key, int(r.whole), float(r.rest)] for r in plan.itertuples() if r.available > 0]
    chosen = spark.createDataFrame(rows, "mix_id string, source string, key string, whole long, rest double")  # MAX_TARGETS rows at most
    # lengths in steps of 1/256 of themselves beyond 4096: some thousand rows per source, however many documents it has
    coarse = F.when(F.col("tokens") <= 4096, F.col("tokens").cast("double")).otherwise(F.exp(F.floor(F.log(F.col("tokens").cast("double")) * 256) / 256))
    lengths = documents.groupBy("key", coarse.alias("tokens")).agg(F.count(F.lit(1)).alias("n"))

    def slope(pdf: pd.DataFrame) -> pd.DataFrame:
        k = _slope(pdf, float(pdf.rest.iloc[0]))
        return pdf.iloc[:1][["mix_id", "source"]].assign(slope=float(k), n=int(round((pdf.n * np.minimum(1.0, k * pdf.tokens)).sum())))

    slopes = lengths.join(F.broadcast(chosen.filter("rest > 0")), "key").groupBy("mix_id", "source").applyInPandas(slope, "mix_id string, source string, slope double, n long")
    chosen = cut_lineage(chosen.join(F.broadcast(slopes), ["mix_id", "source"], "left").select("mix_id", "source", "key", "whole", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("n", F.lit(0)).alias("n")))
    chosen = F.broadcast(chosen)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "mix_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    pi = F.least(F.lit(1.0), F.col("slope") * F.col("tokens"))
    odds = F.when(pi >= 1.0, F.lit(0.0)).otherwise(u / (1 - u) / (pi / (1 - pi)))
    each = documents.join(chosen, "key").withColumn("rank_odds", F.when(F.col("n") > 0, odds))
    each = cut_lineage(each.withColumn("slice", F.floor(F.col("rank_odds") / (1 + F.col("rank_odds")) * SLICES)))
    by = ["mix_id", "source"]
    filled = each.filter("n > 0").groupBy(*by, "n", "slice").agg(F.count(F.lit(1)).alias("m"))
    limit = filled.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy("slice"))).filter("upto >= n and upto - m < n").select(*by, F.col("slice").alias("limit_slice"), (F.col("n") - F.col("upto") + F.col("m")).alias("still"))
    each = each.join(F.broadcast(limit), by, "left")
    edge = each.filter("slice = limit_slice").withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("rank_odds", "doc_id"))).filter("place <= still").select(*by, "doc_id", F.lit(1).alias("extra_at_edge"))
    out = each.join(edge, [*by, "doc_id"], "left").withColumn("copies", F.col("whole") + F.when(F.coalesce(F.col("slice") < F.col("limit_slice"), F.lit(False)) | F.col("extra_at_edge").isNotNull(), 1).otherwise(0))
    return out.filter("copies > 0").select(*by, "doc_id", "tokens", "copies")


def shares(mixture: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """(mix_id, source, target_pct, actual_pct, tokens, met): what each source gives to its mixture's budget."""
    spark = mixture.sparkSession
    budget = plan.groupby("mix_id").wanted.sum()
    rows = [[r.mix_id, r.source, int(r.target_pct), float(budget[r.mix_id]), bool(r.met)] for r in plan.itertuples()]
    wanted = spark.createDataFrame(rows, "mix_id string, source string, target_pct int, budget double, met boolean")
    got = mixture.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    return wanted.join(got, ["mix_id", "source"], "left").select("mix_id", "source", "target_pct", F.round(F.coalesce("tokens", F.lit(0)) * 100 / F.col("budget"), 4).alias("actual_pct"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "met")
