"""Queries over corpora, normal forms, words, pieces' shapes and vocabularies of characters and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import training as L
from ..operators import vocabulary as V
from ..operators.segment import char_pieces, token_counts, unknown_runs_merged
from ..session import table
from ..spec import BOUNDARY, RARE, SPACE, NormalizerSpec, TrainerSpec

PLAIN = NormalizerSpec("identity")
SYMBOLS = ["run", "the merge table", "the", "lot"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return C.lines(table(spark, d, "documents"))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "refrow").select("text", F.col("weight").alias("freq"), F.col("shard").alias("meta"))
    return rows.filter("text is not null").withColumn("freq", F.coalesce("freq", F.lit(1)))


def _escaped(spark: SparkSession, d: str) -> DataFrame:
    return C.normalized(_lines(spark, d), PLAIN)


def corpus_lines(spark, d):
    return _lines(spark, d)


def corpus_usable(spark, d):
    return C.usable(_lines(spark, d))


def corpus_filter_report(spark, d):
    return C.filter_report(_lines(spark, d))


def corpus_prepared(spark, d):
    return C.prepared(_weighted(spark, d), PLAIN, longest=1 << 30)


def corpus_head(spark, d):
    return C.head(_weighted(spark, d).select("text", "freq"), 500, "freq", "text")


def corpus_sample(spark, d):
    return C.sample(_lines(spark, d), 500)


def corpus_masked(spark, d):
    return C.masked(_lines(spark, d), SYMBOLS)


def corpus_replaced(spark, d):
    return _lines(spark, d).select(T.replace_all_column("text", SYMBOLS, "#").alias("text"))


def normalize_escaped(spark, d):
    return _lines(spark, d).select(T.normalize_column("text", PLAIN).alias("norm"))


def normalize_suffix(spark, d):
    return _lines(spark, d).select(T.normalize_column("text", NormalizerSpec("identity", suffix=True)).alias("norm"))


def normalize_kept_blanks(spark, d):
    return _lines(spark, d).select(T.normalize_column("text", NormalizerSpec("identity", remove_extra_whitespaces=False)).alias("norm"))


def normalize_unescaped(spark, d):
    return _lines(spark, d).select(T.normalize_column("text", NormalizerSpec("identity", escape_whitespaces=False, add_dummy_prefix=False)).alias("norm"))


def normalize_nmt(spark, d):
    return table(spark, d, "refrow").select("row_id", T.normalize_column("text", NormalizerSpec("nmt")).alias("norm"))


def normalize_nfc(spark, d):
    return table(spark, d, "surface_form").select("surface_id", T.normalize_column("surface", NormalizerSpec("nfc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)).alias("norm"))


def normalize_nmt_nfkc(spark, d):
    return table(spark, d, "refrow").select("row_id", T.normalize_column("text").alias("norm"))


def normalize_aligned(spark, d):
    rows = table(spark, d, "refrow").select("row_id", "text", T.aligned_column("text").alias("a"))
    o = F.col("a.origin")
    return rows.select("row_id", F.col("a.text").alias("norm"), F.size(o).alias("n"), F.element_at(o, 1).alias("first"), F.element_at(o, -1).alias("last"))


def utf8_report(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return raw.select("doc_id", F.octet_length("raw").alias("bytes"), F.char_length(T.decode_column("raw")).alias("chars"), F.is_valid_utf8(F.col("raw").cast("string")).alias("valid"), T.sha256_column("raw").alias("sha256"))


def word_table(spark, d):
    return V.word_table(_escaped(spark, d))


def word_table_suffix(spark, d):
    return V.word_table(C.normalized(_lines(spark, d), NormalizerSpec("identity", suffix=True)), suffix=True)


def word_table_weighted(spark, d):
    return V.word_table(C.normalized(_weighted(spark, d), PLAIN), freq="freq")


def word_table_blank_runs(spark, d):
    rows = C.normalized(_lines(spark, d), NormalizerSpec("identity", remove_extra_whitespaces=False))
    return V.word_table(rows, whitespace_only=True)


def split_interval(spark, d):
    return V.word_table(_escaped(spark, d), interval=True)


def split_barline(spark, d):
    return V.word_table(_escaped(spark, d), barline=True)


def char_histogram(spark, d):
    return V.char_histogram(_lines(spark, d))


def char_alphabet(spark, d):
    return V.alphabet(V.char_histogram(_escaped(spark, d)), 0.9995).select("char", "freq", "kept")


def piece_shapes(spark, d):
    spec = TrainerSpec(max_piece_length=16)
    loose = TrainerSpec(max_piece_length=16, split_by_script=False, split_by_whitespace=False)
    pieces = table(spark, d, "spill_entry").select("piece").filter("piece is not null").distinct()
    return pieces.select("piece", T.valid_piece_column("piece", spec).alias("valid"), T.valid_piece_column("piece", loose).alias("valid_loose"))


def scripts(spark, d):
    chars = V.char_histogram(_lines(spark, d))
    return chars.select("char", "freq", T.script_column("char").alias("script"))


def char_train(spark, d):
    spec = TrainerSpec("char", vocab_size=5000, use_all_vocab=False)
    return V.vocabulary(spark, L.train(_lines(spark, d), spec, PLAIN)).select("piece_id", "piece", F.round(F.col("score").cast("double"), 4).alias("score"), "type")


def word_train(spark, d):
    spec = TrainerSpec("word", vocab_size=3000, character_coverage=1.0, hard_vocab_limit=False)
    return V.vocabulary(spark, L.train(_lines(spark, d), spec, PLAIN)).select("piece_id", "piece", F.round(F.col("score").cast("double"), 4).alias("score"), "type")


def char_usage(spark, d):
    model = L.train(_lines(spark, d), TrainerSpec("char", vocab_size=300), PLAIN)
    known = V.vocabulary(spark, model)
    pieces = _escaped(spark, d).select(F.explode(char_pieces("text")).alias("piece"))
    ids = V.piece_ids(pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), known)
    return ids.groupBy("id").agg(F.sum("n").alias("n"))


def char_tokens(spark, d):
    """The same through the encoder, with each unknown stretch as one token."""
    model = L.train(_lines(spark, d), TrainerSpec("char", vocab_size=300), PLAIN)
    return token_counts(_lines(spark, d), model)


def unknown_runs(spark, d):
    spans = table(spark, d, "token_span")
    ids = spans.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("ids"))
    merged = unknown_runs_merged("ids", 0)
    return ids.select("row_id", F.size("ids").alias("before"), F.size(merged).alias("after"))


QUERIES = {f.__name__: f for f in (
    corpus_lines, corpus_usable, corpus_filter_report, corpus_prepared, corpus_head, corpus_sample, corpus_masked, corpus_replaced, normalize_escaped, normalize_suffix,
    normalize_kept_blanks, normalize_unescaped, normalize_nmt, normalize_nfc, normalize_nmt_nfkc, normalize_aligned, utf8_report, word_table, word_table_suffix,
    word_table_weighted, word_table_blank_runs, split_interval, split_barline, char_histogram, char_alphabet, piece_shapes, scripts, char_train, word_train, char_usage, char_tokens, unknown_runs,
)}

LINES = "l as (select unnest(string_split(text, chr(10))) as text from documents)"
CLEAN = "regexp_replace(trim(text, ' '), ' +', ' ', 'g')"
ESC = f"e as (select '{SPACE}' || replace({CLEAN}, ' ', '{SPACE}') as text from l where {CLEAN} <> '')"
WORDS = f"w as (select '{SPACE}' || unnest(string_split(text[2:], '{SPACE}')) as word from e)"
NMT = "".join(f"chr({n}) || " for n in T.K.NMT_BLANKS) + "".join(f"chr({n}) || " for n in T.K.NMT_DROPPED)
NMT_TO = "repeat(' ', %d)" % len(T.K.NMT_BLANKS)
LETTERS = "c as (select char, count(*) freq from (select unnest(string_split(text, '')) as char from e) where char not in ('', ' ', chr(0)) group by char)"
COVER = "k as (select char, freq, coalesce(sum(freq) over (order by freq desc, char rows between unbounded preceding and 1 preceding), 0) / sum(freq) over () < 0.9995 as kept from c)"
USABLE = f"l as (select * from (select unnest(string_split(text, chr(10))) as text from documents) where text <> '' and strlen(text) <= 4192 and not contains(text, '▅'))"
WEIGHTED = "l as (select text, coalesce(weight, 1) freq, shard as meta from refrow where text is not null)"
SPECIAL = "select 0 piece_id, '<unk>' piece, 0.0::double score, 'UNKNOWN' as type union all select 1, '<s>', 0.0, 'CONTROL' union all select 2, '</s>', 0.0, 'CONTROL'"
MASK = "the merge table|the|run|lot"
#: Scripts that both engines know; kana count as Han.
SQL_SCRIPTS = [x for x in "Latin Cyrillic Greek Thai Devanagari Arabic Hebrew Hangul Inherited Armenian Georgian Bengali Tamil Telugu Kannada Malayalam Gujarati Gurmukhi Oriya Sinhala Khmer Lao Myanmar Tibetan Ethiopic Mongolian Cherokee Bopomofo Yi Syriac Thaana Coptic Braille".split()]
SCRIPT_CASES = "when regexp_matches(char, '[\\p{Han}\\p{Hiragana}\\p{Katakana}ー]') then 'Han' " + " ".join(f"when regexp_matches(char, '\\p{{{x}}}') then '{x}'" for x in SQL_SCRIPTS)
ONE_SCRIPT = "|".join(["[0-9０-９]+", "\\p{Inherited}+", "[\\p{Han}\\p{Hiragana}\\p{Katakana}ー][\\p{Han}\\p{Hiragana}\\p{Katakana}ー\\p{Inherited}]*", *(f"\\p{{{x}}}[\\p{{{x}}}\\p{{Inherited}}]*" for x in SQL_SCRIPTS if x != "Inherited")])


def shape_sql(piece: str, longest: int) -> str:
    """Whether a column of strings may be pieces under the default options."""
    own = f"replace({piece}, '{SPACE}', '')"
    one = f"({own} = '' or regexp_full_match({own}, '{ONE_SCRIPT}') or (regexp_full_match({own}, '\\p{{Common}}[\\p{{Common}}\\p{{Inherited}}]*', 's') and not regexp_matches({own}, '[0-9０-９ー]')))"
    return f"length({piece}) <= {longest} and not regexp_matches({piece}, '[{RARE}\\x00{BOUNDARY} ]') and not contains({piece}[2:], '{SPACE}') and {one}"


def shapes_sql(longest: int) -> str:
    """A CTE ``s(piece, plain, one)`` of the distinct pieces: whether length and characters are allowed, and whether all is of one script."""
    return f"""with p as (select distinct piece from spill_entry where piece is not null), q as (select piece, replace(piece, '{SPACE}', '') own, length(piece) between 1 and {longest} and not regexp_matches(piece, '[{RARE}\\x00{BOUNDARY} ]') plain from p),
s as (select piece, plain, own = '' or regexp_full_match(own, '{ONE_SCRIPT}') or (regexp_full_match(own, '\\p{{Common}}[\\p{{Common}}\\p{{Inherited}}]*', 's') and not regexp_matches(own, '[0-9０-９ー]')) one from q)"""


SQL = {
    "corpus_lines": f"with {LINES} select text from l",
    "corpus_usable": f"with {USABLE} select text from l",
    "corpus_filter_report": f"with {LINES} select case when coalesce(text, '') = '' then 'empty' when strlen(text) > 4192 then 'too long' when contains(text, '▅') then 'reserved' else 'kept' end reason, count(*) n from l group by 1",
    "corpus_prepared": f"with {WEIGHTED} select '{SPACE}' || replace({CLEAN}, ' ', '{SPACE}') as text, coalesce(meta, '') meta, sum(freq)::bigint freq from l where {CLEAN} <> '' group by 1, 2",
    "corpus_head": f"with {WEIGHTED} select text, freq from l order by freq, text limit 500",
    "corpus_masked": f"with {LINES} select regexp_replace(text, '{MASK}', chr(31), 'g') as text from l",
    "corpus_replaced": f"with {LINES} select regexp_replace(text, '{MASK}', '#', 'g') as text from l",
    "normalize_escaped": f"with {LINES} select case when {CLEAN} = '' then '' else '{SPACE}' || replace({CLEAN}, ' ', '{SPACE}') end norm from l",
    "normalize_suffix": f"with {LINES} select case when {CLEAN} = '' then '' else replace({CLEAN}, ' ', '{SPACE}') || '{SPACE}' end norm from l",
    "normalize_kept_blanks": f"with {LINES} select case when text = '' then '' else replace(' ' || text, ' ', '{SPACE}') end norm from l",
    "normalize_unescaped": f"with {LINES} select {CLEAN} norm from l",
    "normalize_nmt": f"with l as (select row_id, translate(text, {NMT}'', {NMT_TO}) as text from refrow) select row_id, case when {CLEAN} = '' then '' else '{SPACE}' || replace({CLEAN}, ' ', '{SPACE}') end norm from l",
    "normalize_nfc": "select surface_id, nfc_normalize(surface) norm from surface_form",
    "utf8_report": "select doc_id, strlen(text)::int as bytes, length(text)::int as chars, true as valid, sha256(text) sha256 from documents",
    "word_table": f"with {LINES}, {ESC}, {WORDS} select word, count(*) freq from w group by word",
    "word_table_suffix": f"with {LINES}, {ESC}, {WORDS} select word[2:] || '{SPACE}' as word, count(*) freq from w group by 1",
    "word_table_weighted": f"with {WEIGHTED}, e as (select {CLEAN} as text, freq from l where {CLEAN} <> '') select '{SPACE}' || word as word, sum(freq)::bigint freq from (select unnest(string_split(text, ' ')) as word, freq from e) group by 1",
    "word_table_blank_runs": f"with {LINES}, e as (select unnest(regexp_extract_all('{SPACE}' || replace(text, ' ', '{SPACE}'), '{SPACE}+[^{SPACE}]*|[^{SPACE}]+')) as word from l where text <> '') select word, count(*) freq from e group by word",
    "split_interval": f"with {LINES}, {ESC}, s as (select unnest(string_split(regexp_replace(text, '{SPACE}([/1-9])', chr(1) || '{SPACE}\\1', 'g'), chr(1))) as word from e) select word, count(*) freq from s where word <> '' group by word",
    "split_barline": f"with {LINES}, {ESC}, s as (select unnest(string_split(replace(text, '{SPACE}|', chr(1) || '{SPACE}|'), chr(1))) as word from e) select word, count(*) freq from s where word <> '' group by word",
    "char_histogram": f"with {LINES}, e as (select text from l), {LETTERS} select char, freq from c",
    "char_alphabet": f"with {LINES}, {ESC}, {LETTERS}, {COVER} select char, freq, kept from k",
    "char_train": f"with {USABLE}, {ESC}, {LETTERS}, {COVER}, t as (select sum(freq) total from k where kept) select piece_id, piece, score, type from ({SPECIAL} union all select (2 + row_number() over (order by freq desc, char))::int, char, round((ln(freq) - ln(total))::float::double, 4), 'NORMAL' from k, t where kept) where piece_id < 5000",
    "word_train": f"with {USABLE}, {ESC}, {WORDS}, c as (select word, count(*) freq from w group by word), t as (select sum(freq) total from c) select piece_id, piece, score, type from ({SPECIAL} union all select (2 + row_number() over (order by freq desc, word))::int, word, round((ln(freq) - ln(total))::float::double, 4), 'NORMAL' from c, t) where piece_id < 3000",
    "char_usage": f"with {USABLE}, {ESC}, {LETTERS}, {COVER}, v as (select char, 2 + row_number() over (order by freq desc, char) id from k where kept qualify id < 300), al as (select unnest(string_split(text, chr(10))) as text from documents), ae as (select '{SPACE}' || replace({CLEAN}, ' ', '{SPACE}') as text from al where {CLEAN} <> ''), p as (select unnest(string_split(text, '')) as char from ae) select coalesce(id, 0)::int id, count(*) n from p left join v using (char) where char <> '' group by 1",
    "char_tokens": f"with {USABLE}, {ESC}, {LETTERS}, {COVER}, v as (select char, 2 + row_number() over (order by freq desc, char) id from k where kept qualify id < 300), al as (select unnest(string_split(text, chr(10))) as text from documents), ae as (select '{SPACE}' || replace({CLEAN}, ' ', '{SPACE}') as text, row_number() over () nth from al where {CLEAN} <> ''), p as (select nth, unnest(string_split(text, '')) as char, unnest(range(1, length(text) + 1)) i from ae), x as (select nth, i, coalesce(id, 0)::int id from p left join v using (char) where char <> ''), y as (select id, lag(id) over (partition by nth order by i) before_id from x) select id, count(*) n from y where not (id = 0 and coalesce(before_id, 1) = 0) group by id",
    "scripts": f"with {LINES}, e as (select text from l), {LETTERS} select char, freq, case {SCRIPT_CASES} else 'Common' end script from c",
    "piece_shapes": f"{shapes_sql(16)} select piece, plain and not contains(piece[2:], '{SPACE}') and one as valid, plain and (length(piece) = 1 or piece[-1] <> '{SPACE}') valid_loose from s",
    "unknown_runs": "with s as (select row_id, seq, id, lag(id) over (partition by row_id order by seq) before_id from token_span) select row_id, count(*)::int as before, sum(case when id = 0 and before_id = 0 then 0 else 1 end)::int as after from s group by row_id",
}
