"""Queries over lattices of segmentations, single steps of trainers, and alignment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import text as T
from ..functions.text import kept
from ..kernels.model import Model
from ..operators import continuation as N
from ..operators import corpus as C
from ..operators import segment as S
from ..operators import training as L
from ..operators import vocabulary as V
from ..session import table
from ..spec import BOUNDARY, SPACE, NormalizerSpec, TrainerSpec
from .models import BEST_PATHS, CLEAN, ESC, PLAIN, TEXTS, WORDS, _ids, _texts, encoded_sql, given, plainly

GAUGE = 0.125


def _surfaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "surface_form").filter("surface is not null").select("surface_id", "surface")


def lattice_total(spark, d):
    """The logarithm of the summed probabilities of all segmentations of every surface."""
    model = plainly(spark, d)

    @arrow_udf("double")
    def total(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        forms = [own.normalize(t) for t in batch.to_pylist()]
        return pa.array([own.kernel.forward(own.kernel.edges(t))[-1] if t else 0.0 for t in forms], pa.float64())

    return _surfaces(spark, d).select("surface_id", F.round(total("surface"), 3).alias("total"))


def nbest_scores(spark, d):
    """The scores of the three best segmentations of every surface."""
    model = plainly(spark, d)

    @arrow_udf("array<double>")
    def scores(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        forms = [own.normalize(t) for t in batch.to_pylist()]
        return pa.array([[s for _, s in own.kernel.nbest(t, 3)] if t else [] for t in forms], pa.list_(pa.float64()))

    return _surfaces(spark, d).select("surface_id", F.posexplode(scores("surface")).alias("nth", "score")).select("surface_id", "nth", F.round("score", 3).alias("score"))


def expected_counts(spark, d):
    """Expected counts of all normal pieces over the words of the corpus."""
    words = L.words_of(C.normalized(_texts(spark, d), PLAIN).withColumn("freq", F.lit(1).cast("bigint")), TrainerSpec()).select(F.col("word").alias("text"), "freq")
    pieces = [(p, s) for p, s, t in given(spark, d).pieces if t == "NORMAL"]
    counts, _ = L.expected_counts(words, pieces)
    # Compared where the count isn't lost in rounding.
    return spark.createDataFrame([(p, round(float(n), 2)) for (p, _), n in zip(pieces, counts) if n >= 0.01], "piece string, n double")


def sampled_best(spark, d):
    """A sample from the single best segmentation is that one."""
    rows = _texts(spark, d).select("row_id", S.sample_ids("text", given(spark, d), 0.5, 3, 1).alias("ids"))
    return rows.select("row_id", F.array_join("ids", " ").alias("ids"))


def encoded_pieces(spark, d):
    return _texts(spark, d).select("row_id", F.array_join(S.encode_pieces("text", given(spark, d), "eos:reverse"), " ").alias("pieces"))


def lowered(m: Model) -> Model:
    return Model(tuple((p, s - i % 23 if t == "NORMAL" else s, t) for i, (p, s, t) in enumerate(m.pieces)), m.trainer, m.normalizer)


def unreachable_pieces(spark, d):
    """Normal pieces of which a split scores higher, with scores lowered by a rule."""
    model = lowered(given(spark, d))
    return spark.createDataFrame([(model.pieces[i][0],) for i in model.kernel.unreachable()], "piece string")


def coverage_gaps(spark, d):
    """Characters of the corpus that the vocabulary can't spell."""
    rows = C.normalized(_texts(spark, d), PLAIN).withColumn("freq", F.lit(1).cast("bigint"))
    return N.uncovered(rows, table(spark, d, "vocab_piece").filter("piece_type = 'NORMAL'").select("piece"))


def gauge_mass(spark, d):
    """The logarithm of the normal pieces' mass, shifted by a gauge times their length."""
    own = [(p, s) for p, s, t in given(spark, d).pieces if t == "NORMAL"]
    mass = N.base_mass(N.np.array([s for _, s in own], float), N.np.array([len(p) for p, _ in own], float), GAUGE)
    return spark.createDataFrame([(round(mass, 4),)], "mass double")


def refitted_characters(spark, d):
    """A refit on a vocabulary of single characters: each score is the logarithm of the character's share."""
    rows = C.normalized(_texts(spark, d), PLAIN).groupBy("text").agg(F.count(F.lit(1)).alias("freq"))
    chars = [r.char for r in V.char_histogram(rows).orderBy("char").collect()]  # at most all of Unicode
    start = Model((("<unk>", 0.0, "UNKNOWN"), *((c, -1.0, "NORMAL") for c in chars)), TrainerSpec("unigram"), PLAIN)
    model, _ = N.refit(rows, start, 1)
    return spark.createDataFrame([(p, round(float(s), 4)) for p, s, t in model.pieces if t == "NORMAL"], "char string, score double")


def first_merges(spark, d):
    """The first merges that are learnt on the corpus, in order."""
    spec = TrainerSpec("bpe", character_coverage=1.0, max_sentence_length=1 << 30, split_by_script=False, split_by_number=False, max_piece_length=512)
    words = L.words_of(C.normalized(_texts(spark, d), PLAIN).withColumn("freq", F.lit(1).cast("bigint")), spec)
    return spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(L.learn_distributed(words, spec, MERGES))], "nth int, left string, right string")


MERGES = 24


def aligned_plain(spark, d):
    rows = _texts(spark, d).select("row_id", "text", T.aligned_column("text", PLAIN).alias("a"))
    o = F.col("a.origin")
    return rows.select("row_id", F.col("a.text").alias("norm"), F.size(o).alias("n"), F.element_at(o, 1).alias("first"), F.element_at(o, -1).alias("last"))


def char_offsets(spark, d):
    """The byte offsets of the token spans as character offsets."""
    spans = table(spark, d, "token_span").groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "end_off"))), lambda x: x["end_off"]).alias("ends"))
    texts = table(spark, d, "refrow").filter("text is not null").groupBy("row_id").agg(F.min_by("text", "arrived_at").alias("text"))
    rows = texts.join(spans, "row_id").select("row_id", T.char_offsets_column(F.col("text"), F.col("ends")).alias("ends"))
    return rows.select("row_id", F.array_join(F.transform("ends", lambda x: x.cast("string")), " ").alias("ends"))


def delimited_words(spark, d):
    """Words of lines whose delimiter is a boundary that no piece crosses."""
    rows = C.delimited(C.normalized(_texts(spark, d), PLAIN), "e").withColumn("freq", F.lit(1).cast("bigint"))
    return L.words_of(rows, TrainerSpec())


def pretokenized_words(spark, d):
    """The same with a split of the caller's, before each capital of ASCII."""
    split = F.filter(F.split("text", "(?=[A-Z])", -1), lambda p: p != "")
    rows = C.pretokenized(C.normalized(_texts(spark, d), PLAIN), split).withColumn("freq", F.lit(1).cast("bigint"))
    return L.words_of(rows, TrainerSpec())


def denormalized(spark, d):
    """Decoded texts with a rule of the model's own applied."""
    m = given(spark, d)
    model = Model(m.pieces, m.trainer, m.normalizer, NormalizerSpec("own", (("e", "E"), ("th", "TH"))))
    return _ids(spark, d).select("row_id", S.decode_ids("ids", model).alias("text"))


QUERIES = {f.__name__: f for f in (
    lattice_total, nbest_scores, expected_counts, sampled_best, encoded_pieces, unreachable_pieces, coverage_gaps, gauge_mass, refitted_characters, first_merges, aligned_plain, char_offsets,
    delimited_words, pretokenized_words, denormalized,
)}

LOWERED = "(score::double - id % 23)"
SURFACE = CLEAN.replace("text", "surface")
SPELLED = f"'{SPACE}' || replace({SURFACE}, ' ', '{SPACE}')"
GIVEN = f"""v as (select piece, case when piece_type = 'USER_DEFINED' then 0.1 * (length(piece) - 1) else score::double end s from vocab_piece where piece_type in ('NORMAL', 'USER_DEFINED')),
u as (select min(score)::double - 10 worst from vocab_piece where piece_type = 'NORMAL'), t as (select distinct {SPELLED} as word from surface_form where {SURFACE} <> '')"""
#: One step over all words: the edges that end at the next place, with the value of the place where they begin.
EDGES = "from r, u, range(1, 25) g(k) left join v on v.piece = r.word[r.n + 2 - k:r.n + 1] where r.n < length(r.word) and k <= r.n + 1 and (v.s is not null or k = 1)"
SQL = {
    "lattice_total": f"""with recursive {GIVEN}, r as (select word, 0 as n, [0.0::double] as a from t union all
  select word, n + 1, list_append(a, m + ln(list_sum(list_transform(x, lambda y: exp(y - m))))) from (select word, n, a, list_max(x) m, x from (select r.word, r.n, any_value(r.a) a, list(r.a[r.n + 2 - k] + coalesce(v.s, worst)) x {EDGES} group by r.word, r.n)))
select surface_id, round(coalesce(a[-1], 0.0), 3) total from surface_form left join (select * from r where n = length(word)) x on x.word = {SPELLED} where surface is not null""",
    "nbest_scores": f"""with recursive {GIVEN}, r as (select word, 0 as n, [[0.0::double]] as a from t union all
  select word, n + 1, list_append(a, list_reverse_sort(x)[:3]) from (select r.word, r.n, any_value(r.a) a, flatten(list(list_transform(r.a[r.n + 2 - k], lambda y: y + coalesce(v.s, worst)))) x {EDGES} group by r.word, r.n)),
b as (select word, a[-1] best from r where n = length(word))
select surface_id, (i - 1)::int nth, round(best[i], 3) score from (select surface_id, best, unnest(range(1, len(best) + 1)) i from surface_form join b on b.word = {SPELLED})""",
    "expected_counts": f"""with recursive {TEXTS}, {ESC}, {WORDS.replace(", t as (", ", tf as (")}, t as (select word from tf), v as (select piece, score::double s from vocab_piece where piece_type = 'NORMAL'), u as (select min(score)::double - 10 worst from vocab_piece where piece_type = 'NORMAL'),
r as (select word, 0 as n, [0.0::double] as a from t union all
  select word, n + 1, list_append(a, m + ln(list_sum(list_transform(x, lambda y: exp(y - m))))) from (select word, n, a, list_max(x) m, x from (select r.word, r.n, any_value(r.a) a, list(r.a[r.n + 2 - k] + coalesce(v.s, worst)) x {EDGES} group by r.word, r.n))),
b as (select word, length(word) as n, [0.0::double] as z from t union all
  select word, n - 1, [m + ln(list_sum(list_transform(x, lambda y: exp(y - m))))] || z from (select word, n, z, list_max(x) m, x from (select b.word, b.n, any_value(b.z) z, list(b.z[k] + coalesce(v.s, worst)) x from b, u, range(1, 25) g(k) left join v on v.piece = b.word[b.n:b.n + k - 1] where b.n > 0 and b.n + k - 1 <= length(b.word) and (v.s is not null or k = 1) group by b.word, b.n))),
w2 as (select r.word, a, z from r join b on r.word = b.word and b.n = 0 where r.n = length(r.word)), x as (select word, a, z, unnest(range(1, length(word) + 1)) i from w2),
y as (select v.piece, sum(freq * exp(a[i] + v.s + z[i + k] - a[-1])) n from x join range(1, 25) g(k) on i + k - 1 <= length(word) join v on v.piece = x.word[i:i + k - 1] join tf using (word) group by v.piece)
select piece, round(n, 2) n from y where n >= 0.01""",
    "sampled_best": f"{encoded_sql('unigram', 'refrow', 'row_id', 'text')} select row_id, array_to_string(ids, ' ') ids from e",
    "encoded_pieces": f"""{encoded_sql('unigram', 'refrow', 'row_id', 'text')}, k as (select row_number() over () nth, row_id, ids from e), y as (select nth, unnest(ids) id, unnest(range(1, len(ids) + 1)) i from k), o as (select nth, string_agg(piece, ' ' order by i desc) pieces from y join vocab_piece using (id) group by nth)
select row_id, '</s>' || coalesce(' ' || pieces, '') pieces from k left join o using (nth)""",
    "unreachable_pieces": f"with recursive t as (select piece as word from vocab_piece where piece_type = 'NORMAL' and length(piece) > 1), {BEST_PATHS.split('q as (select word, length')[0].rstrip().rstrip(',').replace('score::double', LOWERED)} select word as piece from r join vocab_piece on piece = word where n = length(word) and best[-1] > {LOWERED}",
    "coverage_gaps": f"with {TEXTS}, {ESC}, c as (select unnest(string_split(text, '')) as piece from e) select piece, count(*) n from c where piece <> '' and piece not in (select piece from vocab_piece where piece_type = 'NORMAL') group by piece",
    "gauge_mass": f"select round(ln(sum(exp(score::double + {GAUGE} * length(piece)))), 4) mass from vocab_piece where piece_type = 'NORMAL'",
    "refitted_characters": f"with {TEXTS}, {ESC}, c as (select unnest(string_split(text, '')) as char from e) select char, round(ln(count(*)::double / sum(count(*)) over ()), 4) score from c where char not in ('', ' ', chr(0)) group by char",
    "first_merges": f"""with recursive {TEXTS}, {ESC}, {WORDS}, r as (select 0 as nth, word, freq, string_split(word, '') as sym, '' as l, '' as r from t union all
  select s.nth + 1, s.word, s.freq, list_reduce(list_transform(s.sym, lambda x: [x]), lambda a, b: case when a[-1] = p.l and b[1] = p.r then a[:-2] || [p.l || p.r] else a || b end), p.l, p.r
  from r s, (select l, r from (select sym[i] l, sym[i + 1] r, freq from (select sym, freq, unnest(range(1, len(sym))) i from r)) where not contains((l || r)[2:], '{SPACE}') group by l, r order by sum(freq) desc, length(l || r), l || r, length(l) limit 1) p where s.nth < {MERGES})
select distinct (nth - 1)::int nth, l as left, r as right from r where nth > 0""",
    "aligned_plain": f"with {TEXTS}, e as (select row_id, text, case when {CLEAN} = '' then '' else '{SPACE}' || replace({CLEAN}, ' ', '{SPACE}') end norm from l) select row_id, norm, (strlen(norm) + 1)::int n, (case when norm = '' then 0 else strlen(text) - strlen(ltrim(text, ' ')) end)::int as first, (case when norm = '' then 0 else strlen(rtrim(text, ' ')) end)::int as last from e",
    "char_offsets": "with s as (select row_id, arg_min(text, arrived_at) as text from refrow where text is not null group by row_id) select row_id, string_agg(length(decode(encode(text)[1:end_off])), ' ' order by seq) ends from token_span join s using (row_id) group by row_id",
    "delimited_words": f"with {TEXTS}, {ESC}, w as (select unnest(string_split(text, 'e')) as part from e), p as (select unnest(regexp_extract_all(part, '{SPACE}[^{SPACE}]*|[^{SPACE}]+')) as word from w) select word, count(*) freq from p where word <> '' group by word",
    "pretokenized_words": f"with {TEXTS}, {ESC}, w as (select unnest(string_split(regexp_replace(text, '([A-Z])', chr(1) || '\\1', 'g'), chr(1))) as part from e), p as (select unnest(regexp_extract_all(part, '{SPACE}[^{SPACE}]*|[^{SPACE}]+')) as word from w) select word, count(*) freq from p where word <> '' group by word",
    "denormalized": f"select row_id, replace(replace(replace(ltrim(string_agg(case when id = 0 then ' ⁇ ' else v.piece end, '' order by seq), '{SPACE}'), '{SPACE}', ' '), 'th', 'TH'), 'e', 'E') as text from token_span left join vocab_piece v using (id) group by row_id",
}
