"""Models on streams: stateless encoding, and running counts with event time.

A model is part of the query; a new one needs the query to be started again. Counts keep state
for each word and window; the watermark bounds it, and rows later than that are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_column, words_column
from ..kernels.model import Model
from ..operators.segment import encode_ids
from ..session import shared_folder
from ..spec import NormalizerSpec


def read_rows(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def encoded_stream(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """rows with ``ids``; for append output."""
    return rows.withColumn("ids", encode_ids(text, model))


def word_counts(rows: DataFrame, at: str, window: str = "1 hour", late: str = "2 hours", text: str = "text", spec: NormalizerSpec = NormalizerSpec("identity")) -> DataFrame:
    """``window, word, freq`` by event time; for append or update output."""
    words = rows.withWatermark(at, late).select(F.col(at), F.explode(words_column(normalize_column(text, spec))).alias("word"))
    return words.groupBy(F.window(at, window).alias("window"), "word").agg(F.count(F.lit(1)).alias("freq"))


def running_words(rows: DataFrame, text: str = "text", spec: NormalizerSpec = NormalizerSpec("identity")) -> DataFrame:
    """``word, freq`` over all rows so far; for complete or update output. Its state grows with the words."""
    return rows.select(F.explode(words_column(normalize_column(text, spec))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


#: Keeps state on the executors' disks; the default one keeps it in their memory.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a bounded stream to its end into files in the shared folder: its rows, for ``complete`` those of the last batch.

    keys: of updates the last one of each key is taken; without keys all updates are.
    """
    spark = stream.sparkSession
    folder, batches = shared_folder(spark, name), []

    def keep(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/__batch={n}")
        batches.append(n)

    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], before)
    query.awaitTermination()
    wanted = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).option("basePath", folder).parquet(*(f"{folder}/__batch={n}" for n in wanted))
    if mode == "update" and keys and len(wanted) > 1:
        rest = [c for c in stream.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("__batch")).alias("__last"))
        rows = last.select(*(F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in stream.columns))
    return rows.select(*stream.columns)
