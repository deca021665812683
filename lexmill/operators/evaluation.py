"""How well a model compresses and predicts a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.model import Model
from .segment import token_counts
from .vocabulary import vocabulary


def evaluate(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """One row of sizes, likelihoods (nats), perplexities and vocabulary use over the non-empty rows; a row counts one byte for its end.

    Over no rows all sizes are 0 and the ratios too.
    """
    rows = df.filter(F.col(text) != "")
    size = rows.agg(F.count(F.lit(1)).alias("sentences"), F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0)).cast("bigint").alias("bytes"))
    counts = token_counts(rows, model, text).join(vocabulary(df.sparkSession, model).select(F.col("piece_id").alias("id"), "score"), "id")
    n = F.col("n").cast("double")
    sums = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("used_pieces"),
        F.coalesce(F.sum(n * F.col("score").cast("double")), F.lit(0.0)).alias("viterbi_nats"), F.coalesce(F.sum(n * F.log(n)), F.lit(0.0)).alias("__nlogn"),
    )
    t, b = F.col("tokens").cast("double"), F.col("bytes").cast("double")
    per = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    one = sums.select(F.struct(*sums.columns).alias("s")).scalar()
    both = size.withColumn("s", one).select("*", "s.*")
    both = both.withColumn("empirical_nats", F.when(t > 0, F.col("__nlogn") - t * F.log(t)).otherwise(0.0))
    nats = F.col("viterbi_nats") if model.trainer.model_type == "unigram" else F.col("empirical_nats")
    return both.select(
        "sentences", "bytes", "tokens", "used_pieces", F.lit(len(model.pieces)).alias("pieces"), "viterbi_nats", "empirical_nats",
        per(nats, b).alias("nats_per_byte"), per(nats, t).alias("nats_per_token"), F.exp(-per(nats, t)).alias("perplexity"), F.exp(-per(nats, b)).alias("byte_perplexity"),
        F.exp(-per(F.col("empirical_nats"), b)).alias("empirical_byte_perplexity"), per(b, t).alias("bytes_per_token"), per(t, b).alias("tokens_per_byte"),
        (F.col("used_pieces") * 100.0 / len(model.pieces)).alias("used_percent"),
    )
