"""Problem 8: mixing sources to target shares by Poisson replication.

Each document is repeated by an inverted Poisson distribution at a uniform number hashed from its
key and the seed, so the mixture doesn't depend on partitions and a lost task repeats itself
exactly. The Poisson is cut off at the source's largest number of repeats, and its rate is set so
that the mean *after* the cut is the repetition the target needs; a source that needs more than
its cap gets every document exactly cap times and is reported as short.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: The plan is broadcast up to so many sources; beyond, it is joined by key.
BROADCAST_SOURCES = 10_000
#: Standard deviations (and as many counts more) around the rate beyond which the Poisson holds no mass that a double could show.
REACH, MORE = 9, 40


def byte_tokens(text: Column) -> Column:
    """Tokens of the byte-level vocabulary: one for each UTF-8 byte and one end token."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


@lru_cache(4096)
def log_factorials(low: int, high: int) -> np.ndarray:
    return np.array([math.lgamma(k + 1) for k in range(low, high)])


def poisson(rate: float, cap: int) -> tuple[int, np.ndarray]:
    """The first count with mass, and P(X <= k) from there on for k below cap."""
    width = REACH * math.sqrt(rate) + MORE
    # In steps of 64, so that near rates share their factorials.
    low, high = max(0, int(rate - width)) // 64 * 64, min(cap, (int(rate + width) // 64 + 1) * 64)
    if low >= high:
        return cap, np.empty(0)
    k = np.arange(low, high)
    return low, np.minimum(1.0, np.cumsum(np.exp(k * math.log(rate) - rate - log_factorials(low, high))))


def cut_mean(rate: float, cap: int) -> float:
    """The mean of min(Poisson(rate), cap) = sum of P(X > k) for k below cap."""
    low, cdf = poisson(rate, cap)
    return low + float((1 - cdf).sum())


def copies(mean: float, cap: int) -> tuple[int, list[float]]:
    """(first, P(copies <= k) for k from first on, below cap) of the Poisson distribution that is cut at cap and has this mean.

    Copies of a document with the uniform number u are first and one more for each entry up to u.
    """
    if cap <= 0 or mean <= 0:
        return 0, []
    if mean >= cap:
        return cap, []
    low, high = 0.0, max(1.0, mean)
    while cut_mean(high, cap) < mean and high < 1e3 * (cap + 10):
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cut_mean(mid, cap) < mean else (low, mid)
    first, cdf = poisson(high, cap)
    most = int(np.searchsorted(cdf, 1 - 1e-13)) + 1
    return first, cdf[:most].tolist()


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(2**53))


def mix_plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target source: sizes, the repetition its share needs, and the distribution of copies.

    docs: ``source, n_tokens``; targets: ``source, target_share, max_repeats``. The total is that
    of all documents, of sources without a target too. A source without documents has size 0. A
    null share or cap counts as 0; a target's source that stands twice is an error; null sources
    match nothing. Sizes are written once: they are as many rows as there are sources.
    """
    sizes = cut(docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs")))
    total = sizes.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).cast("bigint"))
    wanted = targets.filter("source is not null").groupBy("source").agg(
        F.coalesce(F.first("target_share"), F.lit(0.0)).cast("double").alias("target_share"), F.coalesce(F.first("max_repeats"), F.lit(0)).cast("int").alias("max_repeats"), F.count(F.lit(1)).alias("__n")
    )
    wanted = wanted.withColumn("source", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("two targets for source "), "source"))).otherwise(F.col("source"))).drop("__n")
    kind = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("cdf", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(kind)
    def drawn(rate: pd.Series, cap: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([copies(r, int(c)) for r, c in zip(rate, cap)], columns=["first", "cdf"])

    plan = wanted.join(sizes, "source", "left").fillna(0, ["source_tokens", "source_docs"]).withColumn("total_tokens", total.scalar())
    plan = plan.withColumn("target_tokens", F.col("target_share") * F.col("total_tokens"))
    plan = plan.withColumn("repetition", F.when(F.col("source_tokens") > 0, F.least(F.col("target_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    return plan.withColumn("copies", drawn("repetition", "max_repeats"))


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 20260101, plan: DataFrame | None = None) -> DataFrame:
    """docs repeated to the targets, with ``copy_no`` from 1, in an order shuffled globally.

    docs: the key (unique, not null), ``source``, ``n_tokens`` and any other columns. Documents
    without a target source are left out, those of a null source too. No document stands more
    than its source's ``max_repeats`` times; repeated texts under several keys are drawn
    independently. An empty table gives an empty mixture. Columns ``copy_no`` and ``shuffle_key``
    of the input give way to those of the mixture. plan: that of ``mix_plan``, if it is there.
    """
    plan = (plan or mix_plan(docs, targets)).select(F.col("source").alias("__source"), F.col("copies.first").alias("__first"), F.col("copies.cdf").alias("__cdf"))
    # How many targets there are is counted before they are broadcast.
    small = len(targets.select("source").take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES
    kept = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    rows = docs.select(F.col(key).alias("__key"), F.col("source").alias("__own"), F.struct(*kept).alias("__row"))
    drawn = rows.join(F.broadcast(plan) if small else plan, F.col("__own") == F.col("__source"))
    u = uniform(F.lit(seed), F.col("__key"))
    n = F.aggregate("__cdf", F.col("__first"), lambda a, x: a + F.when(x <= u, 1).otherwise(0))
    drawn = drawn.select("__key", "__row", n.alias("__n")).filter("__n > 0").select("__key", "__row", F.explode(F.sequence(F.lit(1), "__n")).alias("copy_no"))
    return drawn.select("__row.*", "copy_no", F.xxhash64(F.lit(seed + 1), "__key", "copy_no").alias("shuffle_key"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mixture in its shuffled order: random partitions, each sorted by the random key."""
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_amounts(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 20260101) -> DataFrame:
    """One row a target source: the plan, what the mixture really holds of it, and whether it is short.

    A source is ``short`` if the mixture holds every one of its documents as often as allowed and
    still less than its target.
    """
    lean = docs.select(key, "source", "n_tokens")
    plan = mix_plan(lean, targets)
    got = mixture(lean, targets, key, seed, plan).groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"), F.max("copy_no").alias("most_copies"))
    out = plan.drop("copies").join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_copies"])
    return out.withColumn("short", (F.col("mixed_docs") == F.col("max_repeats") * F.col("source_docs")) & (F.col("target_tokens") > F.col("mixed_tokens")))


def mix_report(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 20260101) -> DataFrame:
    """The same with the mixture's size and each source's actual share of it."""
    out = cut(mix_amounts(docs, targets, key, seed))  # one row a source, read twice
    whole = out.agg(F.sum("mixed_tokens")).scalar()
    return out.withColumn("mixture_tokens", whole).withColumn("actual_share", F.when(F.col("mixture_tokens") > 0, F.col("mixed_tokens") / F.col("mixture_tokens")).otherwise(0.0))
