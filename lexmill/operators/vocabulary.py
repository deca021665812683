"""Vocabularies as DataFrames: building, lookups, checks, histograms and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words_column
from ..kernels.model import Model
from ..spec import RARE, TYPES, TYPE_NUMBERS, UNKNOWN, VOCABULARY

#: Vocabularies up to so many pieces are broadcast; larger ones are joined by key.
BROADCAST_PIECES = 2_000_000


def vocabulary(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(i, p, float(s), t) for i, (p, s, t) in enumerate(model.pieces)]
    return spark.createDataFrame(rows, VOCABULARY)


def model_pieces(vocab: DataFrame) -> tuple[tuple[str, float, str], ...]:
    """The pieces of a vocabulary table, whose ids must be dense from 0."""
    rows = vocab.orderBy("piece_id").collect()
    if [r.piece_id for r in rows] != list(range(len(rows))):
        raise ValueError("ids must be dense from 0")
    return tuple((r.piece, r.score, r.type) for r in rows)


def _small(vocab: DataFrame) -> DataFrame:
    return F.broadcast(vocab) if len(vocab.select(F.lit(1)).take(BROADCAST_PIECES + 1)) <= BROADCAST_PIECES else vocab


def piece_ids(df: DataFrame, vocab: DataFrame, piece: str = "piece", unk: int = 0) -> DataFrame:
    """df with ``id``: that of the piece, else the unknown one."""
    known = _small(vocab.select(F.col("piece").alias("__piece"), F.col("piece_id").alias("id")))
    return df.join(known, F.col(piece) == F.col("__piece"), "left").drop("__piece").withColumn("id", F.coalesce("id", F.lit(unk)))


def id_pieces(df: DataFrame, vocab: DataFrame, id: str = "id") -> DataFrame:
    """df with ``piece, score, type`` of the id; null out of range."""
    known = _small(vocab.select(F.col("piece_id").alias("__id"), "piece", "score", "type"))
    return df.join(known, F.col(id) == F.col("__id"), "left").drop("__id")


def vocabulary_faults(vocab: DataFrame) -> DataFrame:
    """``fault, n`` of everything that keeps a vocabulary from loading; no row for a valid one."""
    p = F.col("piece")
    each = vocab.select(
        F.array_compact(F.array(
            F.when(p.isNull() | (p == ""), "empty piece"), F.when(F.octet_length(p) >= 8000, "too long"), F.when(F.contains(p, F.lit("\0")), "holds NUL"),
            F.when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "unknown type"), F.when((F.col("type") == "NORMAL") & (F.isnan("score") | (F.abs("score") == float("inf"))), "score not finite"),
        )).alias("faults")
    ).select(F.explode("faults").alias("fault"))
    twice = vocab.groupBy("piece").count().filter("count > 1").select(F.lit("piece twice").alias("fault"))
    ids = vocab.groupBy("piece_id").count().filter("count > 1").select(F.lit("id twice").alias("fault"))
    whole = vocab.agg(F.sum((F.col("type") == UNKNOWN).cast("int")).alias("unknown"), F.max("piece_id").alias("last"), F.min("piece_id").alias("first"), F.count(F.lit(1)).alias("n"))
    overall = whole.select(F.explode(F.array_compact(F.array(
        F.when(F.coalesce("unknown", F.lit(0)) != 1, "not one unknown piece"), F.when((F.col("first") != 0) | (F.col("last") != F.col("n") - 1), "ids not dense"),
    ))).alias("fault"))
    return each.unionByName(twice).unionByName(ids).unionByName(overall).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def word_table(df: DataFrame, text: str = "text", freq: str | None = None, **shape: bool) -> DataFrame:
    """``word, freq`` of escaped texts, weighted."""
    weight = F.col(freq) if freq else F.lit(1).cast("bigint")
    words = df.select(F.explode(words_column(text, **shape)).alias("word"), weight.alias("freq"))
    return words.groupBy("word").agg(F.sum("freq").cast("bigint").alias("freq"))


def char_histogram(df: DataFrame, text: str = "text", freq: str | None = None) -> DataFrame:
    """``char, freq``: weighted counts of characters but NUL and the blank."""
    weight = F.col(freq) if freq else F.lit(1).cast("bigint")
    chars = df.select(F.explode(F.split(F.col(text), "", -1)).alias("char"), weight.alias("freq")).filter("char not in ('', ' ', '\0')")
    return chars.groupBy("char").agg(F.sum("freq").cast("bigint").alias("freq"))


def alphabet(histogram: DataFrame, coverage: float = 0.9995, required: str = "", use_all: bool = False) -> DataFrame:
    """``char, freq, required, kept``: characters are kept, the most frequent first, while the share of those before is below the coverage.

    The histogram is as long as the alphabet, at most all of Unicode, so one window over it is bounded.
    """
    must = sorted(set(required))
    h = histogram.withColumn("required", F.col("char").isin(*must) if must else F.lit(False))
    if must:
        spark = histogram.sparkSession
        missing = spark.createDataFrame([(c, 0, True) for c in must], "char string, freq bigint, required boolean")
        h = h.unionByName(missing).groupBy("char").agg(F.sum("freq").cast("bigint").alias("freq"), F.max("required").alias("required"))
    order = Window.orderBy(F.col("required").desc(), F.col("freq").desc(), F.col("char"))
    before = F.coalesce(F.sum("freq").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("freq").over(Window.partitionBy(F.lit(1)))
    kept = F.col("required") | (before / total < coverage) if not use_all else F.lit(True)
    return h.withColumn("kept", (kept & (F.col("char") != RARE)) if not use_all else kept)


def exported(vocab: DataFrame, form: str = "vocab") -> DataFrame:
    """``piece_id, line``: 'vocab' lines of piece and score, 'syms' of piece and id, 'pieces' of the piece only."""
    if form not in ("vocab", "syms", "pieces"):
        raise ValueError(f"unknown form {form!r}")
    second = {"vocab": F.concat(F.lit("\t"), F.format_string("%s", F.col("score"))), "syms": F.concat(F.lit("\t"), F.col("piece_id").cast("string")), "pieces": F.lit("")}[form]
    return vocab.select("piece_id", F.concat("piece", second).alias("line"))


def id_map_hash(vocab: DataFrame) -> DataFrame:
    """``sha256`` over the lines id, piece, number of the type in the order of ids. A vocabulary's size bounds the one list."""
    number = F.coalesce(*(F.when(F.col("type") == t, F.lit(str(n))) for t, n in TYPE_NUMBERS.items()))
    line = F.concat_ws("\t", F.col("piece_id").cast("string"), "piece", number)
    ordered = F.array_sort(F.collect_list(F.struct("piece_id", line.alias("line"))))
    return vocab.agg(F.sha2(F.concat(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n"), F.lit("\n")).cast("binary"), 256).alias("sha256"))
