"""Queries over models: encoding, decoding, lookups, merges, seeds, evaluation, id overlays."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.merges import Overlay
from ..kernels.model import Model
from ..operators import corpus as C
from ..operators import evaluation, overlay
from ..operators import segment as S
from ..operators import training as L
from ..operators import vocabulary as V
from ..session import table
from ..spec import SPACE, NormalizerSpec, TrainerSpec
from .texts import shape_sql

PLAIN = NormalizerSpec("identity")


def given(spark: SparkSession, d: str, kind: str = "unigram", normalizer: NormalizerSpec = PLAIN) -> Model:
    """The vocabulary of the test data as a model (fixed size)."""
    vocab = table(spark, d, "vocab_piece").withColumnsRenamed({"id": "piece_id", "piece_type": "type"})
    return Model(V.model_pieces(vocab), TrainerSpec(kind, byte_fallback=True), normalizer).checked()


def plainly(spark: SparkSession, d: str, kind: str = "unigram") -> Model:
    """The same without byte pieces: what is unknown stays."""
    m = given(spark, d, kind)
    return Model(tuple((p, s, "UNUSED" if t == "BYTE" else t) for p, s, t in m.pieces), TrainerSpec(kind), PLAIN)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "refrow").filter("text is not null").select("row_id", "text").distinct()


def _ids(spark: SparkSession, d: str, field: str = "id") -> DataFrame:
    spans = table(spark, d, "token_span")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", field))), lambda x: x[field])
    return spans.groupBy("row_id").agg(ordered.alias("ids"))


def vocabulary_faults(spark, d):
    vocab = table(spark, d, "vocab_piece").withColumnsRenamed({"id": "piece_id", "piece_type": "type"})
    broken = vocab.unionByName(vocab.filter("piece_id in (0, 300)")).unionByName(spark.createDataFrame([(9999, "", 0.0, "WHAT")], V.VOCABULARY))
    return V.vocabulary_faults(broken)


def vocabulary_lines(spark, d):
    return V.exported(table(spark, d, "vocab_piece").withColumnsRenamed({"id": "piece_id"}), "syms")


def id_map_hash(spark, d):
    return V.id_map_hash(table(spark, d, "vocab_piece").withColumnsRenamed({"id": "piece_id", "piece_type": "type"}))


def piece_ids(spark, d):
    vocab = table(spark, d, "vocab_piece").withColumnsRenamed({"id": "piece_id", "piece_type": "type"})
    return V.piece_ids(table(spark, d, "spill_entry").filter("piece is not null").select("entry_id", "piece").distinct(), vocab)


def id_pieces(spark, d):
    vocab = table(spark, d, "vocab_piece").withColumnsRenamed({"id": "piece_id", "piece_type": "type"})
    return V.id_pieces(table(spark, d, "token_span").select("row_id", "seq", "id"), vocab).select("row_id", "seq", "id", "piece", "type")


def word_encode(spark, d):
    model = L.train(C.lines(table(spark, d, "documents")), TrainerSpec("word", vocab_size=3000, character_coverage=1.0, hard_vocab_limit=False), PLAIN)
    words = V.word_table(C.normalized(_texts(spark, d), PLAIN))
    return V.piece_ids(words, V.vocabulary(spark, model), "word").select("word", "freq", "id")


def encode_unigram(spark, d):
    rows = _texts(spark, d).select("row_id", "text", S.encode_ids("text", given(spark, d)).alias("ids"))
    return rows.select("row_id", F.array_join("ids", " ").alias("ids"), F.size("ids").alias("n"))


def encode_long(spark, d):
    """The same with long texts cut into parts."""
    rows = S.encode_long(_texts(spark, d), given(spark, d), "row_id", chunk=300)
    return rows.select("row_id", F.array_join("ids", " ").alias("ids"), F.size("ids").alias("n"))


def encode_best_score(spark, d):
    """The score of the best path of every surface."""
    surfaces = table(spark, d, "surface_form").select("surface_id", "surface")
    return surfaces.select("surface_id", F.round(S.best_score("surface", plainly(spark, d)), 3).alias("score"))


def encode_pairs(spark, d):
    rows = _texts(spark, d).select("row_id", "text", S.encode_ids("text", given(spark, d, "bpe")).alias("ids"))
    return rows.select("row_id", F.array_join("ids", " ").alias("ids"), F.size("ids").alias("n"))


def _roundtrip(spark, d, ids):
    model = given(spark, d)
    rows = _texts(spark, d).select("row_id", "text", ids(model).alias("ids"))
    return rows.select("row_id", "text", S.decode_ids("ids", model).alias("decoded"))


def roundtrip_unigram(spark, d):
    return _roundtrip(spark, d, lambda m: S.encode_ids("text", m))


def roundtrip_pairs(spark, d):
    return _roundtrip(spark, d, lambda m: S.encode_ids("text", Model(m.pieces, TrainerSpec("bpe", byte_fallback=True), PLAIN)))


def roundtrip_sampled(spark, d):
    return _roundtrip(spark, d, lambda m: S.sample_ids("text", m, 0.3, 7))


def roundtrip_dropout(spark, d):
    return _roundtrip(spark, d, lambda m: S.sample_ids("text", Model(m.pieces, TrainerSpec("bpe", byte_fallback=True), PLAIN), 0.2, 7))


def roundtrip_options(spark, d):
    return _roundtrip(spark, d, lambda m: S.with_options(S.encode_ids("text", m), "eos:bos", m))


def roundtrip_nbest(spark, d):
    """The third-best segmentation of every surface, decoded again."""
    model = given(spark, d)
    rows = table(spark, d, "surface_form").select("surface_id", "surface", F.try_element_at(S.encode_nbest("surface", model, 3), F.lit(-1)).alias("ids"))
    return rows.select("surface_id", "surface", S.decode_ids("ids", model).alias("decoded"))


def spans_cover(spark, d):
    """Surfaces of the pieces put together, and the end of the last."""
    model = given(spark, d, normalizer=NormalizerSpec("identity", remove_extra_whitespaces=False))
    rows = _texts(spark, d).filter("text <> ''").select("row_id", S.encode_spans("text", model).alias("s"))
    return rows.select("row_id", F.array_join("s.surface", "").alias("text"), F.element_at(F.col("s.end"), -1).alias("bytes"))


def decode_given(spark, d):
    return _ids(spark, d, "piece").select("row_id", S.decode_pieces("ids", plainly(spark, d)).alias("text"))


def decode_built_in(spark, d):
    return _ids(spark, d, "piece").select("row_id", S.spelled("ids").alias("text"))


def decode_spans(spark, d):
    model = plainly(spark, d)
    spans = _ids(spark, d).select("row_id", F.posexplode(S.decode_spans("ids", model)).alias("seq", "s"))
    return spans.select("row_id", "seq", F.col("s.id").alias("id"), "s.piece")


def options_applied(spark, d):
    model = given(spark, d)
    return _ids(spark, d).select("row_id", F.array_join(S.with_options("ids", "bos:eos:reverse", model), " ").alias("ids"))


def byte_fallback(spark, d):
    """Characters without a piece of their own, as their bytes' pieces."""
    model = given(spark, d, normalizer=NormalizerSpec("identity", add_dummy_prefix=False))
    chars = V.char_histogram(_texts(spark, d)).filter(~F.col("char").isin(SPACE, "\n", "\r", "\t")).select("char")
    known = table(spark, d, "vocab_piece").select(F.col("piece").alias("char"))
    return chars.join(known, "char", "left_anti").select("char", F.array_join(S.encode_pieces("char", model), "").alias("pieces"))


def vocabulary_used(spark, d):
    return S.used_vocabulary(_texts(spark, d), given(spark, d), V.vocabulary(spark, given(spark, d)))


def evaluation_report(spark, d):
    report = evaluation.evaluate(table(spark, d, "documents"), L.train(table(spark, d, "documents"), TrainerSpec("char", vocab_size=4000, character_coverage=1.0, max_sentence_length=1 << 30), PLAIN))
    return report.select("sentences", "bytes", F.round("bytes_per_token", 3).alias("bytes_per_token"), "tokens")


def pair_counts(spark, d):
    return L.pair_counts(L.symbols_of(V.word_table(C.normalized(_texts(spark, d), PLAIN)))).select("left", "right", "n")


def first_pairs(spark, d):
    pairs = L.pair_counts(L.symbols_of(V.word_table(C.normalized(C.lines(table(spark, d, "documents")), PLAIN))))
    return L.first_pair(pairs, 25).select("left", "right", "n")


def pair_applied(spark, d):
    words = V.word_table(C.normalized(_texts(spark, d), PLAIN))
    symbols = words.select("word", F.filter(F.split("word", "", -1), lambda c: c != "").alias("symbols"))
    return symbols.select("word", F.array_join(L.pair_applied(L.pair_applied("symbols", "e", "r"), "a", "a"), " ").alias("symbols"))


def train_pairs(spark, d):
    spec = TrainerSpec("bpe", vocab_size=1500, character_coverage=0.99)
    model, merges = L.train_pairs(C.lines(table(spark, d, "documents")), spec, PLAIN)
    return V.vocabulary(spark, model)


def train_unigram(spark, d):
    """With the trainer's own seeds, piece length and size."""
    rows = table(spark, d, "refrow").filter("text is not null").select("text")
    return V.vocabulary(spark, L.train(rows, TrainerSpec("unigram", hard_vocab_limit=False), PLAIN))


def seed_substrings(spark, d):
    spec = TrainerSpec(max_piece_length=6, split_by_script=False)
    rows = C.normalized(table(spark, d, "part").select(F.col("p_name").alias("text"), F.lit(1).cast("bigint").alias("freq")), PLAIN)
    return L.repeated_substrings(rows, spec)


def seed_substrings_lines(spark, d):
    """The substrings that the trainer's seeds are taken from, with its own options."""
    spec = TrainerSpec("unigram")
    rows = L.training_rows(table(spark, d, "refrow").filter("text is not null").select("text"), spec, PLAIN)
    return L.repeated_substrings(rows, spec)


BASE, SIZE = 40, 48
PROGRAM = [(0, 1, 2, 40, (1, 2)), (1, 3, 4, 41, (3, 4)), (2, 40, 3, 42, (1, 2, 3)), (3, 5, 5, 43, (5, 5)), (4, 43, 41, 44, (5, 5, 3, 4)), (5, 7, 1, 45, (7, 1))]


@cache
def program() -> Overlay:
    return Overlay(BASE, SIZE, 38, 39, PROGRAM, frozenset({9}))


def _streams(spark: SparkSession, d: str) -> DataFrame:
    """Ids per user out of the events, each stream as one fenced block after its first id."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 11 + F.col("user_id") % 3).cast("int").alias("id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "id"))), lambda x: x["id"])
    return e.groupBy("user_id").agg(ids.alias("ids")).select("user_id", F.concat(F.slice("ids", 1, 1), F.array(F.lit(38)), "ids", F.array(F.lit(39))).alias("ids"))


def overlay_encoded(spark, d):
    return _streams(spark, d).select("user_id", F.array_join(overlay.overlay_encode("ids", program()), " ").alias("ids"))


def overlay_restored(spark, d):
    """Encoded with dropout and expanded again: the streams themselves."""
    coded = _streams(spark, d).select("user_id", overlay.overlay_encode("ids", program(), 0.4, F.col("user_id")).alias("ids"))
    return coded.select("user_id", F.array_join(overlay.overlay_expand("ids", program()), " ").alias("ids"))


def overlay_built_in(spark, d):
    coded = _streams(spark, d).select("user_id", overlay.overlay_encode("ids", program()).alias("ids"))
    return coded.select("user_id", F.array_join(overlay.expanded("ids", program()), " ").alias("ids"))


def overlay_counts(spark, d):
    return _streams(spark, d).select("user_id", overlay.overlay_stats("ids", program()).alias("s")).select("user_id", "s.merges", "s.dropped")


QUERIES = {f.__name__: f for f in (
    vocabulary_faults, vocabulary_lines, id_map_hash, piece_ids, id_pieces, word_encode, encode_unigram, encode_long, encode_best_score, encode_pairs, roundtrip_unigram, roundtrip_pairs, roundtrip_sampled,
    roundtrip_dropout, roundtrip_options, roundtrip_nbest, spans_cover, decode_given, decode_built_in, decode_spans, options_applied, byte_fallback, vocabulary_used,
    evaluation_report, pair_counts, first_pairs, pair_applied, train_pairs, train_unigram, seed_substrings, seed_substrings_lines, overlay_encoded, overlay_restored, overlay_built_in, overlay_counts,
)}

CLEAN = "regexp_replace(trim(text, ' '), ' +', ' ', 'g')"
TEXTS = "l as (select distinct row_id, text from refrow where text is not null)"
ESC = f"e as (select '{SPACE}' || replace({CLEAN}, ' ', '{SPACE}') as text from l where {CLEAN} <> '')"
WORDS = f"w as (select '{SPACE}' || unnest(string_split(text[2:], '{SPACE}')) as word from e), t as (select word, count(*) freq from w group by word)"
ROUND = f"with {TEXTS} select row_id, text, {CLEAN} as decoded from l"
DOCS = "l as (select unnest(string_split(text, chr(10))) as text from documents)"
PAIRS = "p as (select word[i] as left, word[i + 1] as right, sum(freq)::bigint n from (select string_split(word, '') as word, freq, unnest(range(1, length(word))) i from t) group by 1, 2)"
#: Segmentations in SQL, of the distinct words t(word): g(word, ids), with the bytes of unknown characters.
BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::int + zero)"
#: The best path: at each place the best score and how long its last piece is; of equal ones the longest, which begins first.
BEST_PATHS = f"""v as (select piece, id, case when piece_type = 'USER_DEFINED' then 0.1 * (strlen(piece) - 1) else score::double end s from vocab_piece where piece_type in ('NORMAL', 'USER_DEFINED')),
u as (select min(score)::double - 10 worst, (select id from vocab_piece where piece = '<0x00>') zero from vocab_piece where piece_type = 'NORMAL'),
r as (select word, 0 as n, [0.0::double] as best, []::int[] as ks from t union all
  select word, n + 1, list_append(best, m.s), list_append(ks, m.k::int) from (select r.word, r.n, any_value(r.best) best, any_value(r.ks) ks, max({{'s': r.best[r.n + 2 - k] + coalesce(v.s, worst), 'k': k}}) m
  from r, u, range(1, 25) g(k) left join v on v.piece = r.word[r.n + 2 - k:r.n + 1] where r.n < length(r.word) and k <= r.n + 1 and (v.s is not null or k = 1) group by r.word, r.n)),
q as (select word, length(word) as pos, []::int[] as ids, ks from r where n = length(word) union all
  select word, (pos - ks[pos])::bigint, (case when v.id is not null then [v.id] else {BYTES.format("word[pos - ks[pos] + 1:pos]")} end) || ids, ks from u, q left join v on v.piece = word[pos - ks[pos] + 1:pos] where pos > 0),
g as (select word, ids from q where pos = 0)"""
#: Merges by score, the leftmost of equal ones first; user-defined pieces are whole from the beginning.
BY_MERGES = f"""v as (select piece, id, score::double s from vocab_piece where piece_type = 'NORMAL'), du as (select piece from vocab_piece where piece_type = 'USER_DEFINED'),
f as (select word, unnest(x) as part, unnest(range(1, len(x) + 1)) i from (select word, regexp_extract_all(word, '<[a-z]{{4}}>|.', 0, 's') x from t)),
z as (select word, flatten(list(case when length(part) = 1 or du.piece is not null then [part] else string_split(part, '') end order by i)) sym from f left join du on du.piece = part group by word),
r as (select word, sym from z union all
  select word, sym[:b - 1] || [sym[b] || sym[b + 1]] || sym[b + 2:] from (select word, any_value(sym) sym, -max({{'s': v.s, 'i': -i}}).i b from (select word, sym, unnest(range(1, len(sym))) i from r) join v on v.piece = sym[i] || sym[i + 1]
  where sym[i] not in (select piece from du) and sym[i + 1] not in (select piece from du) group by word)),
h as (select word, arg_min(sym, len(sym)) sym from r group by word), o as (select word, unnest(sym) as part, unnest(range(1, len(sym) + 1)) i from h),
n as (select piece, id from vocab_piece where piece_type in ('NORMAL', 'USER_DEFINED')),
g as (select word, flatten(list(case when n.id is not null then [n.id] else {BYTES.format("part")} end order by i)) ids from (select id as zero from vocab_piece where piece = '<0x00>'), o left join n on n.piece = part group by word)"""


def encoded_sql(kind: str, table: str, key: str, text: str, rows: str = "distinct") -> str:
    """CTEs that end in ``e(key, ids)``: the ids of each text of a table."""
    clean = CLEAN.replace("text", "t0")
    return f"""with recursive l as (select {rows} {key}, {text} as t0 from {table} where {text} is not null), c as (select {key}, t0, {clean} as c0, row_number() over () nth from l),
p as (select {key}, nth, '{SPACE}' || unnest(string_split(replace(c0, '{SPACE}', ' '), ' ')) as word, unnest(range(1, len(string_split(replace(c0, '{SPACE}', ' '), ' ')) + 1)) as i from c where c0 <> ''),
t as (select distinct word from p), {BEST_PATHS if kind == 'unigram' else BY_MERGES},
j as (select nth, flatten(list(ids order by i)) ids from p join g using (word) group by nth), e as (select {key}, t0, coalesce(ids, []) ids from c left join j using (nth))"""


STREAMS = "s as (select user_id, list((event_id % 11 + user_id % 3)::int order by event_id) ids from events group by user_id), x as (select user_id, [ids[1]] || [38] || ids || [39] as ids from s)"
MERGED = "ids"
for _rank, _l, _r, _c, _ in PROGRAM:
    # A rule at a time: left and right next to each other, from the left on. Only (5, 5) can overlap itself.
    MERGED = f"list_reduce(list_transform({MERGED}, lambda x: [x]), lambda a, b: case when a[-1] = {_l} and b[1] = {_r} then a[:-2] || [{_c}] else a || b end)"
SQL = {
    "vocabulary_faults": "with v as (select id, piece, piece_type t from vocab_piece union all select id, piece, piece_type from vocab_piece where id in (0, 300) union all select 9999, '', 'WHAT') select 'empty piece' fault, count(*) n from v where piece = '' union all select 'unknown type', count(*) from v where t = 'WHAT' union all select 'piece twice', count(*) from (select piece from v group by piece having count(*) > 1) union all select 'id twice', count(*) from (select id from v group by id having count(*) > 1) union all select 'not one unknown piece', 1 union all select 'ids not dense', 1",
    "encode_best_score": f"""with recursive v as (select piece, case when piece_type = 'USER_DEFINED' then 0.1 * (strlen(piece) - 1) else score::double end s from vocab_piece where piece_type in ('NORMAL', 'USER_DEFINED')),
u as (select min(score)::double - 10 worst, (select id from vocab_piece where piece = '<0x00>') zero from vocab_piece where piece_type = 'NORMAL'),
w as (select distinct '{SPACE}' || replace({CLEAN.replace('text', 'surface')}, ' ', '{SPACE}') as word from surface_form where {CLEAN.replace('text', 'surface')} <> ''),
r as (select word, 0 as n, [0.0::double] as best from w union all
  select r.word, r.n + 1, list_append(any_value(r.best), max(r.best[r.n + 2 - k] + coalesce(v.s, worst)))
  from r, u, range(1, 25) g(k) left join v on v.piece = r.word[r.n + 2 - k:r.n + 1] where r.n < length(r.word) and k <= r.n + 1 and (v.s is not null or k = 1) group by r.word, r.n)
select surface_id, round(coalesce(best[-1], 0.0), 3) score from surface_form left join (select * from r where n = length(word)) x on x.word = '{SPACE}' || replace({CLEAN.replace('text', 'surface')}, ' ', '{SPACE}')""",
    "encode_unigram": f"{encoded_sql('unigram', 'refrow', 'row_id', 'text')} select row_id, array_to_string(ids, ' ') ids, len(ids)::int n from e",
    "encode_long": f"{encoded_sql('unigram', 'refrow', 'row_id', 'text')} select row_id, array_to_string(ids, ' ') ids, len(ids)::int n from e",
    "encode_pairs": f"{encoded_sql('bpe', 'refrow', 'row_id', 'text')} select row_id, array_to_string(ids, ' ') ids, len(ids)::int n from e",
    "vocabulary_used": f"{encoded_sql('unigram', 'refrow', 'row_id', 'text')} select piece, count(*) n from (select unnest(ids) id from e) join vocab_piece using (id) where piece_type not in ('UNKNOWN', 'CONTROL') group by piece",
    "overlay_counts": f"with {STREAMS} select user_id, (len(ids) - len({MERGED}))::bigint merges, 0::bigint dropped from x",
    "vocabulary_lines": "select id as piece_id, piece || chr(9) || id as line from vocab_piece",
    "id_map_hash": "select sha256(string_agg(id || chr(9) || piece || chr(9) || case piece_type when 'NORMAL' then 1 when 'UNKNOWN' then 2 when 'CONTROL' then 3 when 'USER_DEFINED' then 4 when 'UNUSED' then 5 else 6 end || chr(10), '' order by id)) sha256 from vocab_piece",
    "piece_ids": "select entry_id, s.piece, coalesce(v.id, 0)::int id from (select distinct entry_id, piece from spill_entry where piece is not null) s left join vocab_piece v on s.piece = v.piece",
    "id_pieces": "select row_id, seq, id, v.piece, v.piece_type as type from token_span t left join vocab_piece v using (id)",
    "roundtrip_unigram": ROUND, "roundtrip_pairs": ROUND, "roundtrip_sampled": ROUND, "roundtrip_dropout": ROUND, "roundtrip_options": ROUND,
    "roundtrip_nbest": f"select surface_id, surface, {CLEAN.replace('text', 'surface')} as decoded from surface_form",
    "spans_cover": f"with {TEXTS} select row_id, text, strlen(text)::int as bytes from l where text <> ''",
    "decode_given": f"select row_id, replace(ltrim(string_agg(piece, '' order by seq), '{SPACE}'), '{SPACE}', ' ') as text from token_span group by row_id",
    "decode_built_in": f"select row_id, ltrim(replace(string_agg(piece, '' order by seq), '{SPACE}', ' '), ' ') as text from token_span group by row_id",
    "decode_spans": "select row_id, seq, t.id, v.piece from token_span t join vocab_piece v using (id)",
    "options_applied": "select row_id, array_to_string(list_reverse([1] || list(id order by seq) || [2]), ' ') ids from token_span group by row_id",
    "byte_fallback": f"with {TEXTS}, c as (select distinct unnest(string_split(text, '')) as char from l) select char, regexp_replace(hex(encode(char)), '(..)', '<0x\\1>', 'g') pieces from c where char not in ('', ' ', chr(0), chr(9), chr(10), chr(13), '{SPACE}') and char not in (select piece from vocab_piece)",
    "pair_counts": f"with {TEXTS}, {ESC}, {WORDS}, {PAIRS} select \"left\", \"right\", n from p",
    "first_pairs": f"with {DOCS}, {ESC}, {WORDS}, {PAIRS} select \"left\", \"right\", n from p order by n desc, \"left\" || \"right\" limit 25",
    "pair_applied": f"with {TEXTS}, {ESC}, {WORDS} select word, trim(replace(replace(regexp_replace(word, '(.)', '\\1 ', 'g'), 'e r ', 'er '), 'a a ', 'aa '), ' ') symbols from t",
    "overlay_restored": f"with {STREAMS} select user_id, array_to_string(ids, ' ') ids from x",
    "overlay_built_in": f"with {STREAMS} select user_id, array_to_string(ids, ' ') ids from x",
    "overlay_encoded": f"with {STREAMS} select user_id, array_to_string({MERGED}, ' ') ids from x",
    "evaluation_report": f"select count(*) sentences, sum(strlen(text) + 1)::bigint bytes, round(sum(strlen(text) + 1)::double / sum(length('{SPACE}' || {CLEAN}))::double, 3) bytes_per_token, sum(length('{SPACE}' || {CLEAN}))::bigint tokens from documents where text <> ''",
    "seed_substrings": f"""with e as (select '{SPACE}' || replace({CLEAN.replace('text', 'p_name')}, ' ', '{SPACE}') as text from part), r as (select text, count(*) freq from e group by text),
b as (select text, freq, unnest(range(1, length(text) + 1)) i from r), s as (select text, freq, i, unnest(range(1, 7)) k from b),
q as (select text[i:i + k - 1] piece, substr(hex(encode(text[i + k:i + k] || chr(0))), 1, 2) nx, freq from s where i + k - 1 <= length(text)),
g as (select piece, sum(freq)::bigint n, count(distinct nx) nexts from q group by piece)
select piece, n from g where n >= 2 and nexts >= 2 and length(piece) >= 2 and not contains(piece[2:], '{SPACE}') and not regexp_matches(piece, '[0-9][^0-9]|[^0-9{SPACE}][0-9]')""",
    "seed_substrings_lines": f"""with l as (select text from refrow where text <> '' and strlen(text) <= 4192 and not contains(text, '▅')), {ESC}, x as (select string_split(text[2:], '{SPACE}') ws from e),
w as (select '{SPACE}' || unnest(ws) as word, case when unnest(range(1, len(ws) + 1)) = len(ws) then chr(0) else '{SPACE}' end as ending from x), r as (select word, ending, count(*) freq from w group by 1, 2),
b as (select word, ending, freq, unnest(range(1, length(word) + 1)) i from r), s as (select word, ending, freq, i, unnest(range(1, least(16, length(word) - i + 1) + 1)) k from b),
q as (select word[i:i + k - 1] piece, substr(hex(encode(word[i + k:i + k] || ending)), 1, 2) nx, freq from s), g as (select piece, sum(freq)::bigint n, count(distinct nx) nexts from q group by piece)
select piece, n from g where n >= 2 and nexts >= 2 and length(piece) >= 2 and {shape_sql('piece', 16)}""",
    "word_encode": f"""with dl as (select unnest(string_split(text, chr(10))) as text from documents), du as (select {CLEAN} as text from dl where strlen(text) <= 4192 and not contains(text, '▅') and {CLEAN} <> ''),
dw as (select '{SPACE}' || unnest(string_split(text, ' ')) as word from du), dc as (select word, count(*) f from dw group by word), v as (select word, 2 + row_number() over (order by f desc, word) id from dc qualify id < 3000),
{TEXTS}, {ESC}, {WORDS} select t.word, t.freq, coalesce(v.id, 0)::int id from t left join v on t.word = v.word""",
}
