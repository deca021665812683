"""Queries over continuations, refits, streams and SQL functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import register
from ..kernels.model import Model
from ..operators import continuation as N
from ..operators import corpus as C
from ..operators import training as L
from ..operators import vocabulary as V
from ..operators.segment import encode_ids
from ..session import table
from ..spec import SPACE, NormalizerSpec, TrainerSpec
from ..streaming import streams
from .models import CLEAN, ESC, PLAIN, TEXTS, WORDS, _texts, encoded_sql, given


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = C.normalized(_texts(spark, d), PLAIN)
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("freq"))


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocab_piece").withColumnsRenamed({"id": "piece_id", "piece_type": "type"})


def continuation_candidates(spark, d):
    words = L.words_of(_rows(spark, d), TrainerSpec()).select(F.col("word").alias("text"), "freq")
    return N.candidates(words, _vocab(spark, d), TrainerSpec(split_by_script=False, split_by_number=False), most=None)


def support_counts(spark, d):
    return N.support_counts(L.symbols_of(V.word_table(C.normalized(_texts(spark, d), PLAIN))))


def ambiguous_pieces(spark, d):
    return N.ambiguous_pieces(_vocab(spark, d))


def prefix_faults(spark, d):
    """A vocabulary against itself with some pieces changed."""
    prior = _vocab(spark, d)
    changed = prior.filter("piece_id % 500 <> 7").withColumn("piece", F.when(F.col("piece_id") % 400 == 9, F.concat("piece", F.lit("x"))).otherwise(F.col("piece")))
    changed = changed.withColumn("score", F.when(F.col("type") == "NORMAL", F.col("score") + 0.25 * F.char_length(F.col("piece"))).otherwise(F.col("score")).cast("float"))
    return N.prefix_faults(prior, changed, 0.25, 1e-3)


def _program(spark: SparkSession, d: str) -> N.Program:
    chars = [r.char for r in V.char_histogram(_rows(spark, d)).orderBy("char").collect()]
    return N.Program((N.Piece(0, "<unk>", "UNKNOWN", False), *(N.Piece(1 + i, c, "NORMAL", True, True) for i, c in enumerate(chars))), ())


def continued_pairs(spark, d):
    """Two hundred merges learnt in two continuations of an alphabet: ids of the first stay."""
    rows = _rows(spark, d)
    one = N.continue_pairs(rows, _program(spark, d), 120)
    two = N.continue_pairs(rows, one, 80)
    return spark.createDataFrame([(p.id, p.piece, p.type) for p in two.pieces], "id int, piece string, type string")


def continued_unigram(spark, d):
    """A vocabulary that leaves a tenth of its mass, with pieces learnt on the corpus behind it."""
    prior = given(spark, d)
    own = [(p, s) for p, s, t in prior.pieces if t == "NORMAL"]
    gauge = N.solve_gauge(np.array([s for _, s in own], float), np.array([len(p) for p, _ in own], float), 0.9)
    prior = Model(tuple((p, s + gauge * len(p) if t == "NORMAL" else s, t) for p, s, t in prior.pieces), prior.trainer, prior.normalizer)
    once = lambda texts: C.normalized(texts, PLAIN).select("text", F.lit(1).cast("bigint").alias("freq"))
    # Which characters there are doesn't depend on rows that come twice, and words are added up whether or not texts were.
    missing = N.uncovered(once(table(spark, d, "refrow").filter("text is not null").select("text")), _vocab(spark, d).filter("type in ('NORMAL', 'USER_DEFINED')").select("piece")).count()
    model, gauge = N.continue_unigram(once(_texts(spark, d)), prior, missing + 600, TrainerSpec("unigram", seed_size=20_000), hard_limit=False)
    return V.vocabulary(spark, model).select("piece_id", "piece", F.round(F.col("score").cast("double"), 3).alias("score"), "type")


def refitted(spark, d):
    base = L.train(table(spark, d, "refrow").filter("text is not null").select("text"), TrainerSpec("unigram", vocab_size=1200, character_coverage=1.0, hard_vocab_limit=False, max_sentence_length=1 << 30), PLAIN)
    model, history = N.refit(_rows(spark, d), base, 2)
    return V.vocabulary(spark, model)


def stream_encoded(spark, d):
    model = given(spark, d)
    rows = streams.read_rows(spark, f"{d}/refrow.parq*", "row_id bigint, text string, weight bigint, meta string, lang string, shard string, created_at timestamp, arrived_at timestamp")
    out = streams.drain(streams.encoded_stream(rows.select("row_id", "text"), model), "encoded_rows")
    return out.select("row_id", F.array_join("ids", " ").alias("ids"))


def stream_words(spark, d):
    rows = streams.read_rows(spark, f"{d}/refrow.parq*", "row_id bigint, text string, weight bigint, meta string, lang string, shard string, created_at timestamp, arrived_at timestamp")
    return streams.drain(streams.running_words(rows), "counted_words", "complete")


def stream_windows(spark, d):
    """Words of the event stream by day; the watermark is wide enough for all rows of one trigger."""
    schema = "row_id bigint, text string, weight bigint, meta string, lang string, shard string, created_at timestamp, arrived_at timestamp"
    rows = streams.read_rows(spark, f"{d}/refrow.parq*", schema).filter("text is not null and created_at is not null")
    out = streams.drain(streams.word_counts(rows, "created_at", "1 day", "36500 days"), "windowed_words", "update", ("window", "word"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "word", "freq")


def sql_tokens(spark, d):
    """Tokens per language through the registered functions."""
    register(spark, given(spark, d), "lm")
    table(spark, d, "refrow").createOrReplaceTempView("lm_rows")
    return spark.sql("select row_id, text, lm_decode(lm_encode(text)) as decoded from lm_rows where text is not null")


def sql_tokenized(spark, d):
    """Ids and their number through the registered functions."""
    register(spark, given(spark, d), "lm")
    table(spark, d, "surface_form").createOrReplaceTempView("lm_forms")
    return spark.sql("select surface_id, array_join(lm_encode(surface), ' ') as ids, lm_count(surface) as n from lm_forms where surface is not null")


def sql_tokenize_rows(spark, d):
    """The same through the table function: one row a token, with its piece and offsets."""
    register(spark, given(spark, d, normalizer=NormalizerSpec("identity", remove_extra_whitespaces=False)), "lm")
    table(spark, d, "surface_form").filter("surface <> ''").createOrReplaceTempView("lm_forms")
    tokens = spark.sql("select surface_id, surface, t.* from lm_forms, lateral lm_tokenize(surface) t")
    raw = F.encode("surface", "UTF-8")
    part = F.decode(F.substring(raw, F.col("begin") + 1, F.col("end") - F.col("begin")), "UTF-8")
    ends = tokens.groupBy("surface_id").agg(F.max("end").alias("bytes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))), lambda x: x["part"]), "").alias("text"))
    return ends.select("surface_id", "bytes", "text")


QUERIES = {f.__name__: f for f in (continuation_candidates, support_counts, ambiguous_pieces, prefix_faults, continued_pairs, continued_unigram, refitted, stream_encoded, stream_words, stream_windows, sql_tokens, sql_tokenized, sql_tokenize_rows)}

SQL = {
    "continuation_candidates": f"""with {TEXTS}, {ESC}, {WORDS}, s as (select word[i:i + k - 1] piece, freq from (select word, freq, i, unnest(range(2, least(16, length(word) - i + 1) + 1)) k from (select word, freq, unnest(range(1, length(word))) i from t)))
select piece, sum(freq)::bigint n from s where not contains(piece[2:], '{SPACE}') and piece not in (select piece from vocab_piece) group by piece having sum(freq) >= 2""",
    "ambiguous_pieces": "with v as (select piece from vocab_piece where piece_type = 'NORMAL'), s as (select piece, piece[1:k] a, piece[k + 1:] b from (select piece, unnest(range(1, length(piece))) k from v)), n as (select piece, count(*) filter (a in (select piece from v) and b in (select piece from v)) splits from s group by piece) select piece, splits from n where splits <> 1",
    "prefix_faults": "select id::int as piece_id, case when id % 500 = 7 then 'missing' else 'piece' end fault from vocab_piece where id % 500 = 7 or id % 400 = 9",
    "stream_windows": f"with l as (select text, strftime(created_at, '%Y-%m-%d') as day from refrow where text is not null and created_at is not null), e as (select {CLEAN} as text, day from l where {CLEAN} <> '') select day, word, count(*) freq from (select day, '{SPACE}' || unnest(string_split(text, ' ')) as word from e) group by day, word",
    "stream_words": f"with l as (select text from refrow where text is not null), e as (select {CLEAN} as text from l where {CLEAN} <> '') select word, count(*) freq from (select '{SPACE}' || unnest(string_split(text, ' ')) as word from e) group by word",
    "sql_tokens": f"select row_id, text, {CLEAN} as decoded from refrow where text is not null",
    "sql_tokenized": f"{encoded_sql('unigram', 'surface_form', 'surface_id', 'surface')} select surface_id, array_to_string(ids, ' ') ids, len(ids)::int n from e",
    "sql_tokenize_rows": "select surface_id, strlen(surface)::int bytes, surface as text from surface_form where surface <> ''",
    "stream_encoded": f"{encoded_sql('unigram', 'refrow', 'row_id', 'text', rows='')} select row_id, array_to_string(ids, ' ') ids from e union all select row_id, null from refrow where text is null",
    "support_counts": f"""with {TEXTS}, {ESC}, {WORDS}, c as (select word, freq, i, word[i] a, word[i + 1] b from (select word, freq, unnest(range(1, length(word))) i from t)),
r as (select *, length(word[1:i]) - length(rtrim(word[1:i], a)) as place from c) select a as "left", b as "right", sum(freq)::bigint n from r where a <> b or place % 2 = 1 group by a, b""",
}
