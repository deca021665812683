"""Queries through files: lines, seeds, symbols, merges and models are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import vocabulary as V
from ..session import shared_folder, table
from ..sources import model_files as M
from ..spec import SPACE, TrainerSpec
from .models import given
from .texts import shapes_sql

FLAT = "translate({}, chr(9) || chr(10) || chr(13), '   ')"


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = shared_folder(spark, name)
    lines.write.mode("overwrite").text(path)
    return path


def _flat(c: str):
    return F.translate(c, "\t\n\r", "   ")


def weighted_lines(spark, d):
    rows = table(spark, d, "refrow").filter("text is not null").select(F.concat_ws("\t", _flat("text"), F.coalesce("weight", F.lit(1)).cast("string")))
    return C.parsed_weights(spark.read.text(_written(spark, rows, "weighted"), lineSep="\n"))


def metadata_lines(spark, d):
    rows = table(spark, d, "refrow").filter("text is not null")
    rows = rows.select(F.concat_ws("\t", _flat("text"), F.coalesce("weight", F.lit(1)).cast("string"), F.coalesce(F.when(F.col("meta") != "", _flat("meta")), F.lit("none"))))
    return C.parsed_weights(spark.read.text(_written(spark, rows, "metadata"), lineSep="\n"), metadata=True)


def _vocabulary(spark: SparkSession, model) -> DataFrame:
    return V.vocabulary(spark, model).select("piece_id", "piece", F.round(F.col("score").cast("double"), 4).alias("score"), "type")


def saved_model(spark, d):
    path = shared_folder(spark, "model")
    M.save(spark, given(spark, d), path)
    return _vocabulary(spark, M.load(spark, path))


def wire_model(spark, d):
    return _vocabulary(spark, M.from_wire(M.to_wire(given(spark, d, "bpe"))))


def vocabulary_file(spark, d):
    path = shared_folder(spark, "syms")
    M.write_lines(V.vocabulary(spark, given(spark, d)), path, "syms")
    return M.numbered_lines(spark, path)


def merges_file(spark, d):
    """Every piece as a merge of its first character with the rest."""
    path = shared_folder(spark, "merges")
    M.write_merges(spark, [(p[0], p[1:]) for p, _, t in given(spark, d).pieces if t == "NORMAL" and len(p) > 1], path)
    return M.read_merges(spark, path).select("rank", "left", "right")


def seeds_file(spark, d):
    """Counted pieces as a seed file: lines of another shape and forbidden pieces are skipped."""
    rows = table(spark, d, "spill_entry").filter("piece is not null").groupBy("piece").agg(F.sum("piece_count").alias("n"))
    lines = rows.select(F.concat_ws("\t", "piece", F.col("n").cast("string")).alias("line")).unionByName(spark.createDataFrame([("no number\tx",), ("three\t1\t2",), ("alone",)], "line string"))
    return M.read_seeds(spark, _written(spark, lines, "seeds"), spec=TrainerSpec(max_piece_length=16))


def symbols_file(spark, d):
    users = table(spark, d, "vocab_piece").filter("piece_type = 'USER_DEFINED'").orderBy("id").select("piece").coalesce(1)
    found = M.read_symbols(spark, _written(spark, users, "symbols"))
    return spark.createDataFrame(list(enumerate(found)), "nth int, piece string")


QUERIES = {f.__name__: f for f in (weighted_lines, metadata_lines, saved_model, wire_model, vocabulary_file, merges_file, seeds_file, symbols_file)}

VOCABULARY = "select id as piece_id, piece, round(score::double, 4) score, piece_type as type from vocab_piece"
SQL = {
    "weighted_lines": f"select {FLAT.format('text')} as text, coalesce(weight, 1) freq from refrow where text is not null",
    "metadata_lines": f"select {FLAT.format('text')} as text, coalesce(weight, 1) freq, coalesce({FLAT.format("nullif(meta, '')")}, 'none') meta from refrow where text is not null",
    "saved_model": VOCABULARY,
    "wire_model": VOCABULARY,
    "vocabulary_file": "select id::int as rank, piece || chr(9) || id as value from vocab_piece",
    "merges_file": "select (row_number() over (order by id) - 1)::int as rank, piece[1] as left, piece[2:] as right from vocab_piece where piece_type = 'NORMAL' and length(piece) > 1",
    "seeds_file": f"{shapes_sql(16)} select piece, n * length(piece) as value from s join (select piece, sum(piece_count)::bigint n from spill_entry group by piece) using (piece) where plain and not contains(piece[2:], '{SPACE}') and one and n > 0 and not regexp_matches(piece, '[\\t\\n\\r]')",
    "symbols_file": "select (row_number() over (order by id) - 1)::int nth, piece from vocab_piece where piece_type = 'USER_DEFINED'",
}
