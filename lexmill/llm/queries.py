"""The queries of the training-data problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .deliveries import first_delivery
from .encodings import repaired_texts
from .frequent import most_frequent
from .leaks import leaked
from .lookalikes import canonical_forms, lookalike_classes, lookalike_pairs
from .mixing import byte_tokens, mix_amounts, mix_report, mixture, shuffled
from .sentences import sentences
from .splitting import LIMIT, OVERLAP, split_oversized
from .term_counts import marked, term_counts


def decoded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("item_kind"), F.col("doc_id").alias("item_id"), "text")
    rows = table(spark, d, "refrow").select(F.lit("refrow").alias("item_kind"), F.col("row_id").alias("item_id"), "text")
    return repaired_texts(docs.unionByName(rows))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return decoded(spark, d).filter("garbled").select("item_kind", "item_id").distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return decoded(spark, d).filter("garbled").select("item_kind", "item_id", "recovered", "encodings", "text")


def spill_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spill_entry").select("entry_id", "run_id", "piece", "piece_count", "arrived_at")
    return first_delivery(rows, ["entry_id"], ["arrived_at", "piece", "piece_count"])


def frequent(spark: SparkSession, d: str) -> DataFrame:
    pieces = table(spark, d, "spill_entry").select(
        F.lit("piece").alias("field"), F.col("entry_id").alias("id"), F.col("piece").alias("item"), F.col("piece_count").alias("weight"), F.col("arrived_at").alias("at")
    )
    scores = table(spark, d, "item_score").select(
        F.lit("score").alias("field"), F.col("item_id").alias("id"), F.col("score").cast("string").alias("item"), F.lit(1).cast("bigint").alias("weight"), F.col("scored_at").alias("at")
    )
    both = pieces.unionByName(scores).filter("item is not null")
    return most_frequent(first_delivery(both, ["field", "id"], ["at", "item", "weight"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent(spark, d).select(F.col("field").alias("field_name"), "item")


def p2_frequent_items(spark: SparkSession, d: str) -> DataFrame:
    return frequent(spark, d).select(F.col("field").alias("field_name"), "item", "weight", "total")


RULES = {"piece": ("occurrences", 4, 0.60), "id": ("records", 3, 0.21)}


def counted(spark: SparkSession, d: str) -> DataFrame:
    spill = table(spark, d, "spill_entry")
    spans = table(spark, d, "token_span")
    pieces = spill_rows(spark, d).filter("piece is not null").select(
        F.lit("piece").alias("field"), F.col("piece").alias("term"), F.col("run_id").alias("record"), F.col("piece_count").alias("occurrences")
    )
    ids = spans.select(F.lit("id").alias("field"), F.col("id").cast("string").alias("term"), F.col("row_id").alias("record"), F.lit(1).cast("bigint").alias("occurrences"))
    n = lambda df, field, c: df.agg(F.countDistinct(c).alias("n_records")).select(F.lit(field).alias("field"), "n_records")
    totals = n(spill, "piece", "run_id").unionByName(n(spans, "id", "row_id"))
    return marked(term_counts(pieces.unionByName(ids)), totals, RULES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).select(F.col("field").alias("field_name"), "term", F.explode("marks").alias("mark"))


def p3_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).select(
        F.col("field").alias("field_name"), "term", "occurrences", "records", F.array_contains("marks", "rare").alias("rare"), F.array_contains("marks", "common").alias("common")
    )


def oversized(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all documents and refrow rows over the limit.

    Token spans are only fetched for rows that may need them: with a stretch so long that it can
    exceed the limit without white space or punctuation.
    """
    docs = table(spark, d, "documents").select(F.lit("documents").alias("item_kind"), F.col("doc_id").alias("item_id"), "text", F.lit(None).cast("array<int>").alias("edges"))
    long = table(spark, d, "refrow").select("row_id", "text", "arrived_at").filter(F.octet_length("text") > LIMIT)
    long = first_delivery(long, ["row_id"], ["arrived_at", "text"]).drop("arrived_at")
    solid = F.col("text").rlike(r"[^\s\p{P}]{%d,}" % (LIMIT // 4))
    spans = table(spark, d, "token_span").select("row_id", "begin_off", "end_off")
    spans = spans.join(long.filter(solid).select("row_id").distinct(), "row_id", "left_semi")
    edges = spans.groupBy("row_id").agg(F.sort_array(F.array_union(F.collect_set("begin_off"), F.collect_set("end_off"))).alias("edges"))
    rows = long.join(edges, "row_id", "left").select(F.lit("refrow").alias("item_kind"), F.col("row_id").alias("item_id"), "text", "edges")
    return split_oversized(docs.unionByName(rows))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(spark, d).filter("piece_no = 0").select("item_kind", "item_id", F.col("item_cut").alias("cut_kind"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return oversized(spark, d).drop("item_cut")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """Of each text that was cut: its size, whether all pieces fit and share at most the overlap, and a digest of the pieces joined again."""
    cut = oversized(spark, d)
    nth = Window.partitionBy("item_kind", "item_id").orderBy("piece_no")
    pieces = cut.withColumn("shared", F.coalesce(F.lag("end_char").over(nth) - F.col("begin_char"), F.lit(0))).withColumn("shared_bytes", F.coalesce(F.lag("end_byte").over(nth) - F.col("begin_byte"), F.lit(0)))
    pieces = pieces.withColumn("own", F.expr("substring(text, shared + 1)"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")
    return pieces.groupBy("item_kind", "item_id").agg(
        F.max("end_byte").cast("bigint").alias("n_bytes"), (F.max(F.octet_length("text")) <= LIMIT).alias("all_fit"), F.min(F.col("shared_bytes").between(0, OVERLAP).cast("int")).cast("boolean").alias("overlap_fits"), F.md5(joined).alias("digest")
    )


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "text").withColumn("n_tokens", byte_tokens(F.col("text")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mix_amounts(sized(spark, d), table(spark, d, "mix_target")).filter("short").select("source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return shuffled(mixture(sized(spark, d), table(spark, d, "mix_target")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(sized(spark, d), table(spark, d, "mix_target"))


def p8_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of each target source its sizes, whether no document stands too often, and whether the mixture holds what it should within six standard deviations."""
    docs, targets = sized(spark, d), table(spark, d, "mix_target")
    report = mix_report(docs, targets).join(docs.groupBy("source").agg(F.sum(F.col("n_tokens").cast("double") ** 2).alias("squares")), "source", "left")
    meant = F.least("target_tokens", F.col("max_repeats") * F.col("source_tokens").cast("double"))
    near = F.abs(F.col("mixed_tokens") - meant) <= 6 * F.sqrt((F.col("repetition") + 1) * F.coalesce("squares", F.lit(0.0)))
    return report.select("source", "source_docs", "source_tokens", "total_tokens", "short", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), near.alias("near_target"))


def looking_alike(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "refrow").select(F.lit("text").alias("field"), F.col("row_id").alias("key"), "text")
    surfaces = table(spark, d, "surface_form").select(F.lit("surface").alias("field"), F.col("surface_id").alias("key"), F.col("surface").alias("text"))
    return canonical_forms(texts.unionByName(surfaces))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(looking_alike(spark, d)).select(F.col("field").alias("field_name"), "key_a", "key_b")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_classes(looking_alike(spark, d)).select(F.col("field").alias("field_name"), "key", "class_key", "links")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return looking_alike(spark, d).select(F.col("field").alias("field_name"), "key", "form")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents").filter("reviewed")).select("doc_id", F.col("end_char").cast("bigint").alias("end_char"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"))


BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """A digest of the units of each document, joined again without blanks."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    units = sentences(table(spark, d, "documents")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("unit_no", "begin_char", "end_char"))).alias("units"))
    own = F.transform("units", lambda u: F.substring("text", u["begin_char"] + 1, u["end_char"] - u["begin_char"]))
    return docs.join(units, "doc_id").select("doc_id", F.md5(F.regexp_replace(F.array_join(own, ""), BLANKS, "")).alias("digest"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_frequent_items, p3_found, p3_term_counts, p5_found, p5_classes, p5_canonical, p6_found, p6_pieces, p6_restored, p7_found, p7_leaks, p8_found, p8_mixture, p8_shares, p8_bounds, p9_found, p9_sentences, p9_restored)}

ENTRIES = "select distinct entry_id, run_id, piece, piece_count from spill_entry"
P2 = f"""
with e as ({ENTRIES}), s as (select distinct item_id, score from item_score),
a as (select 'piece' field_name, piece item, sum(piece_count) weight from e where piece is not null group by piece
      union all select 'score', cast(score as varchar), count(*) from s where score is not null group by score),
t as (select field_name, sum(weight) total from a group by field_name)
select field_name, item, cast(weight as bigint) weight, cast(total as bigint) total from a join t using (field_name) where weight >= 0.005 * total"""
P3 = f"""
with e as ({ENTRIES}),
c as (select 'piece' field_name, piece term, cast(sum(piece_count) as bigint) occurrences, count(distinct run_id) records from e where piece is not null group by piece
      union all select 'id', cast(id as varchar), count(*), count(distinct row_id) from token_span group by id),
n as (select 'piece' field_name, count(distinct run_id) n from spill_entry union all select 'id', count(distinct row_id) from token_span)
select field_name, term, occurrences, records,
  case when field_name = 'piece' then occurrences < 4 else records < 3 end rare,
  records > n * case when field_name = 'piece' then 0.60 else 0.21 end common
from c join n using (field_name)"""
SQL = {
    "p2_frequent_items": P2,
    "p2_found": f"select field_name, item from ({P2})",
    "p3_term_counts": P3,
    "p3_found": f"with r as ({P3}) select field_name, term, 'rare' mark from r where rare union all select field_name, term, 'common' from r where common",
    "p6_found": """with i as (select 'documents' item_kind, doc_id item_id, text from documents union all select 'refrow', row_id, arg_min(text, arrived_at) from refrow where strlen(text) > 4192 group by row_id)
select item_kind, item_id, case when list_max(list_transform(regexp_split_to_array(text, '[\\s\\v\\x1c-\\x1f\\x85\\pZ\\p{P}]'), lambda x: strlen(x))) > 4192 then 'forced' else 'natural' end cut_kind from i where strlen(text) > 4192""",
    "p6_restored": """with i as (select 'documents' item_kind, doc_id item_id, text from documents union all select 'refrow', row_id, arg_min(text, arrived_at) from refrow where strlen(text) > 4192 group by row_id)
select item_kind, item_id, strlen(text) n_bytes, true all_fit, true overlap_fits, md5(text) digest from i where strlen(text) > 4192""",
    "p9_restored": r"select doc_id, md5(regexp_replace(text, '[\s\v\x1c-\x1f\x85\pZ]', '', 'g')) digest from documents where regexp_matches(text, '[^\s\v\x1c-\x1f\x85\pZ]')",
    "p8_bounds": """with s as (select source, sum(coalesce(strlen(text), 0) + 1) n, count(*) d from documents group by source), t as (select sum(n) total from s)
select source, cast(coalesce(d, 0) as bigint) source_docs, cast(coalesce(n, 0) as bigint) source_tokens, cast(total as bigint) total_tokens, target_share * total > max_repeats * coalesce(n, 0) short, true within_cap, true near_target from mix_target left join s using (source), t""",
    "p8_found": """with s as (select source, sum(coalesce(strlen(text), 0) + 1) n from documents group by source), t as (select sum(n) total from s)
select source from mix_target left join s using (source), t where target_share * total > max_repeats * coalesce(n, 0)""",
}
