"""Queries over fences, hierarchies and ranked programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import hierarchy as H
from ..operators import training as L
from ..operators import vocabulary as V
from ..operators.continuation import Piece, Program, unfenced_stretches
from ..session import shared_folder, table
from ..spec import SPACE, NormalizerSpec, TrainerSpec
from .models import CLEAN, ESC, PLAIN, TEXTS, WORDS, _texts

FENCES = ["the", "lot"]
#: Ranked merges of the fixed program; a merge's child is a piece of its own behind the characters.
RULES = [("t", "h"), ("th", "e"), ("i", "n"), ("e", "r"), ("in", "g"), ("a", "n"), (SPACE, "the"), ("r", "e"), ("s", "s"), ("o", "n"), ("on", "s"), ("a", "t")]


def _words(spark: SparkSession, d: str) -> DataFrame:
    rows = C.normalized(_texts(spark, d), PLAIN).withColumn("freq", F.lit(1).cast("bigint"))
    return L.words_of(rows, TrainerSpec()).select(F.col("word").alias("text"), "freq")


def hierarchy_support(spark, d):
    """Support of neighbours in words whose first character and rest are the two children of a parent, within the first five characters."""
    n, first, five = F.char_length("text"), F.octet_length(F.substring("text", 1, 1)), F.octet_length(F.substring("text", 1, 5))
    gates = F.when(n > 1, F.concat(F.lit("1:0,"), first.cast("string"), F.lit(","), F.octet_length("text").cast("string"))).otherwise("")
    rows = L.symbols_of(_words(spark, d).withColumnRenamed("text", "word"))
    rows = rows.withColumn("text", F.array_join("symbols", "")).withColumn("gates", gates).withColumn("ranges", F.concat(F.lit("0-"), five.cast("string")))
    return H.record_support(rows, frozenset()).select("left", "right", "n", "applied")


def hierarchy_file(spark, d):
    """The words with a line each in a sidecar file, joined to their rows again."""
    words = _words(spark, d).filter(~F.col("text").rlike("[\\t\\n\\r]")).withColumn("meta", F.sha2(F.col("text").cast("binary"), 256))
    lines = words.select(F.concat_ws("\t", "text", "meta", F.lit(""), F.concat(F.lit("0-"), F.octet_length("text").cast("string"))).alias("value"))
    path = shared_folder(spark, "sidecar")
    spark.createDataFrame([("# any-bpe-hierarchy-v2",)], "value string").write.text(f"{path}/0")
    lines.write.text(f"{path}/1")
    side = H.read_sidecar(spark, [f"{path}/0", f"{path}/1"])
    return H.with_hierarchy(words, side).select("text", "meta", "freq", "gates", "ranges")


def unfenced(spark, d):
    rows = C.normalized(_texts(spark, d), PLAIN)
    return rows.select("row_id", F.array_join(unfenced_stretches("text", FENCES), "\x1f").alias("parts"))


def _fixed(spark: SparkSession, d: str) -> Program:
    rows = C.normalized(table(spark, d, "surface_form").filter("surface is not null").select(F.col("surface").alias("text")), PLAIN)
    chars = sorted({r.char for r in V.char_histogram(rows).collect()} | {c for pair in RULES for c in "".join(pair)})  # at most all of Unicode
    pieces = [Piece(0, "<unk>", "UNKNOWN", False), *(Piece(1 + i, c, "NORMAL", True, True) for i, c in enumerate(chars))]
    return Program((*pieces, *(Piece(len(pieces) + i, a + b) for i, (a, b) in enumerate(RULES))), tuple(RULES)).checked()


def expansion_encoded(spark, d):
    """Surfaces under a fixed ranked program over their characters, as pieces."""
    program = _fixed(spark, d)
    names = F.array(*(F.lit(p.piece) for p in sorted(program.pieces, key=lambda p: p.id)))
    rows = table(spark, d, "surface_form").filter("surface is not null").select("surface_id", F.col("surface").alias("text"))
    coded = rows.withColumn("ids", H.encode_expansion(L.normalize_column("text", NormalizerSpec("identity")), program))
    return coded.select("surface_id", F.array_join(F.transform("ids", lambda i: F.element_at(names, i + 1)), "\x1f").alias("pieces"))


def program_identity(spark, d):
    """The identity of the fixed program's pieces: of the characters and the merges behind them."""
    return spark.createDataFrame([(_fixed(spark, d).identity(),)], "sha256 string")


def learnt_records(spark, d):
    """Merges learnt on the surfaces under fences: their support, and how often each is applied."""
    program = _fixed(spark, d)
    base = Program(tuple(p for p in program.pieces if p.atomic or p.type == "UNKNOWN"), ())
    rows = C.normalized(table(spark, d, "surface_form").filter("surface is not null").select(F.col("surface").alias("text")), PLAIN).groupBy("text").agg(F.count(F.lit(1)).alias("freq"))
    got = H.continue_records(rows, base, 60, TrainerSpec("bpe"), tuple(FENCES), hard_limit=False)
    return spark.createDataFrame([(n, *c) for n, c in enumerate(got.counts)], "nth int, left string, right string, supported bigint, applied bigint")


QUERIES = {f.__name__: f for f in (hierarchy_support, hierarchy_file, unfenced, expansion_encoded, program_identity, learnt_records)}

SURFACE = CLEAN.replace("text", "surface")
RANKS = "m as (select * from (values " + ", ".join(f"({n}, '{a}', '{b}')" for n, (a, b) in enumerate(RULES)) + ") x(rank, l, r))"
CHARS = f"c as (select distinct ch from (select unnest(string_split('{SPACE}' || replace({SURFACE}, ' ', '{SPACE}'), '')) as ch from surface_form where {SURFACE} <> '' union all select unnest(string_split('{''.join(a + b for a, b in RULES)}', ''))) where ch not in ('', ' ', chr(0)))"
SQL = {
    "hierarchy_support": f"""with {TEXTS}, {ESC}, {WORDS}, c as (select word, freq, i, word[i] a, word[i + 1] b from (select word, freq, unnest(range(1, length(word))) i from t)),
r as (select *, (i > 1 or length(word) = 2) and i < 5 as supported, a <> b or (length(word[1:i]) - length(rtrim(word[1:i], a))) % 2 = 1 as live from c)
select a as "left", b as "right", (sum(freq) filter (supported))::bigint n, sum(freq)::bigint applied from r where live group by a, b having sum(freq) filter (supported) > 0""",
    "hierarchy_file": f"with {TEXTS}, {ESC}, {WORDS} select word as text, sha256(word) meta, freq, '' gates, '0-' || strlen(word) ranges from t where not regexp_matches(word, '[\\t\\n\\r]')",
    "unfenced": f"with {TEXTS}, e as (select row_id, '{SPACE}' || replace({CLEAN}, ' ', '{SPACE}') as text from l where {CLEAN} <> '') select row_id, array_to_string(list_filter(regexp_split_to_array(text, '{'|'.join(FENCES)}'), lambda x: x <> ''), chr(31)) parts from e",
    "expansion_encoded": f"""with recursive {RANKS}, t as (select distinct '{SPACE}' || replace({SURFACE}, ' ', '{SPACE}') as word from surface_form where {SURFACE} <> ''), r as (select word, string_split(word, '') sym from t union all
  select word, sym[:b - 1] || [sym[b] || sym[b + 1]] || sym[b + 2:] from (select word, any_value(sym) sym, min({{'k': m.rank, 'i': i}}).i b from (select word, sym, unnest(range(1, len(sym))) i from r) join m on m.l = sym[i] and m.r = sym[i + 1] group by word)),
h as (select word, arg_min(sym, len(sym)) sym from r group by word)
select surface_id, coalesce(array_to_string(sym, chr(31)), '') pieces from surface_form left join h on word = '{SPACE}' || replace({SURFACE}, ' ', '{SPACE}') where surface is not null""",
    "program_identity": f"""with {CHARS}, {RANKS}, n as (select count(*) n from c), p as (select 0 id, '<unk>' piece, 2 kind union all select row_number() over (order by ch), ch, 1 from c union all select n + 1 + rank, l || r, 1 from m, n)
select sha256(string_agg(id || chr(9) || piece || chr(9) || kind || chr(10), '' order by id)) sha256 from p""",
}
