"""Command lines: ``python -m lexmill.cli train|encode|decode|normalize|export|evaluate|refit|charsmap|continue|expand``.

Thin drivers over the operators. Input is text files, one row a line; output a folder of text
files in the rows' order within each file, or with ``--show`` the first rows.
"""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_column
from .kernels.text import named_rules, read_rules, without_redundant, write_rules
from .operators import continuation, corpus, evaluation, hierarchy, segment, training, vocabulary
from .session import local_session
from .sources import model_files
from .spec import NormalizerSpec, TrainerSpec

#: How encoded rows are written.
FORMATS = ("piece", "id", "proto", "nbest_piece", "nbest_id", "nbest_proto", "sample_piece", "sample_id", "sample_proto", "spans", "vocabulary")


def spec_of(kind: type, options: list[str]):
    """Options given as name=value; tuples as values with commas."""
    known = {f.name: f.default for f in fields(kind)}
    values = {}
    for o in options:
        name, _, v = o.partition("=")
        if name not in known:
            raise SystemExit(f"unknown option {name!r}")
        d = known[name]
        values[name] = v.lower() in ("1", "true", "yes") if isinstance(d, bool) else tuple(filter(None, v.split(","))) if isinstance(d, tuple) else type(d)(v) if d is not None else v
    return kind(**values)


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def encoded(rows: DataFrame, model, form: str, args) -> DataFrame:
    """One column of lines; an n-best list is a line for each of its segmentations. ``proto`` forms are JSON of pieces with their surfaces and offsets."""
    kind, _, what = form.rpartition("_")
    if form == "spans" or (what == "proto" and not kind):
        return rows.select(F.to_json(segment.encode_spans("value", model)))
    if not kind:
        return rows.select(joined(segment.encode_ids("value", model, args.options) if form == "id" else segment.encode_pieces("value", model, args.options)))
    if kind == "nbest":
        rows = rows.select(F.explode(segment.encode_nbest("value", model, args.size)).alias("ids"))
    else:
        rows = rows.select(segment.sample_ids("value", model, args.alpha, args.seed, args.size).alias("ids"))
    if what == "id":
        return rows.select(joined(F.col("ids")))
    if what == "proto":
        return rows.select(F.to_json(segment.decode_spans("ids", model)))
    names = F.array(*map(F.lit, (p for p, _, _ in model.pieces)))
    return rows.select(joined(F.transform("ids", lambda i: F.element_at(names, i + 1))))


def put(rows: DataFrame, args) -> None:
    if args.show:
        for r in rows.limit(args.show).collect():
            print(r[0])
    else:
        rows.write.mode("overwrite").text(args.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__.splitlines()[0])
    p.add_argument("command", choices=("train", "encode", "decode", "normalize", "export", "evaluate", "refit", "charsmap", "continue", "expand"))
    p.add_argument("--input", nargs="+", default=[])
    p.add_argument("--output", default="")
    p.add_argument("--model", default="")
    p.add_argument("--format", default="piece", choices=(*FORMATS, "vocab", "syms", "pieces", "text", "tsv", "short"))
    p.add_argument("--options", default="", help="bos, eos and reverse, with colons between")
    p.add_argument("--set", nargs="*", default=[], help="training options, name=value")
    p.add_argument("--normalizer", nargs="*", default=[], help="options of the normal form, name=value")
    p.add_argument("--rules", default="", help="a file of rules in hexadecimal code points")
    p.add_argument("--alpha", type=float, default=0.1)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--size", type=int, default=-1)
    p.add_argument("--fences", nargs="*", default=[], help="strings whose edges no merge crosses")
    p.add_argument("--show", type=int, default=0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or local_session()
    rows = spark.read.text(args.input) if args.input else None
    normal = spec_of(NormalizerSpec, args.normalizer)
    if args.rules:
        normal = replace(normal, name="own", rules=tuple(read_rules(r.value for r in spark.read.text(args.rules).collect()).items()))
    if args.command == "train":
        df = corpus.parsed_weights(rows) if args.format == "tsv" else rows.select(F.col("value").alias("text"))
        model_files.save(spark, training.train(df, spec_of(TrainerSpec, args.set), normal), args.output)
        return
    if args.command == "charsmap":  # a named or given form as a rule file, or the rules inside a model
        spec = model_files.load(spark, args.model).normalizer if args.model else normal
        rules = dict(spec.rules) if spec.rules is not None else named_rules(spec.name)
        lines = write_rules(without_redundant(rules) if args.format == "short" else rules)
        put(spark.createDataFrame(list(enumerate(lines)), "n int, line string").coalesce(1).sortWithinPartitions("n").select("line"), args)
        return
    if args.command in ("continue", "expand"):  # a ranked program, in a directory or, to begin with, of the corpus's characters
        weighted = corpus.parsed_weights(rows) if args.format == "tsv" else rows.select(F.col("value").alias("text"), F.lit(1).cast("bigint").alias("freq"))
        if args.model:
            base, about = hierarchy.load_program(spark, args.model)
            inherited = NormalizerSpec(**{k: tuple(map(tuple, v)) if isinstance(v, list) else v for k, v in about["normalizer"].items()})
            normal = hierarchy.reconciled(inherited, normal)
        if args.command == "expand":
            put(rows.select(joined(hierarchy.encode_expansion(normalize_column("value", normal), base))), args)
            return
        text = corpus.normalized(weighted, normal).groupBy("text").agg(F.sum("freq").cast("bigint").alias("freq"))
        if not args.model:
            chars = [r.char for r in vocabulary.char_histogram(text).orderBy("char").collect()]  # at most all of Unicode
            base = continuation.Program((continuation.Piece(0, "<unk>", "UNKNOWN", False), *(continuation.Piece(1 + i, c, "NORMAL", True, True) for i, c in enumerate(chars))), ())
        spec = spec_of(TrainerSpec, ["model_type=bpe", *args.set])
        fences = tuple(hierarchy.normalised_fences(args.fences, normal)) if args.fences else ()
        hierarchy.save_learnt(spark, hierarchy.continue_records(text, base, args.size, spec, fences, spec.hard_vocab_limit), base, args.output, normal)
        return
    if args.command == "normalize" and not args.model:
        put(rows.select(normalize_column("value", normal)), args)
        return
    model = model_files.load(spark, args.model)
    if args.command == "encode" and args.format == "vocabulary":
        used = segment.used_vocabulary(rows.withColumnRenamed("value", "text"), model, vocabulary.vocabulary(spark, model))
        put(used.orderBy(F.desc("n"), "piece").select(F.concat_ws("\t", "piece", F.col("n").cast("string"))).coalesce(1), args)
    elif args.command == "encode":
        put(encoded(rows, model, args.format, args), args)
    elif args.command == "decode":
        parts = F.filter(F.split("value", " ", -1), lambda x: x != "")
        by_id = segment.decode_ids(F.filter(F.transform(parts, lambda x: x.try_cast("int")), lambda x: x.isNotNull()), model)
        put(rows.select(by_id if args.format == "id" else segment.decode_pieces(parts, model)), args)
    elif args.command == "normalize":
        put(rows.select(normalize_column("value", model.normalizer)), args)
    elif args.command == "export":
        put(vocabulary.exported(vocabulary.vocabulary(spark, model), args.format).orderBy("piece_id").select("line").coalesce(1), args)
    elif args.command == "evaluate":
        report = evaluation.evaluate(rows.withColumnRenamed("value", "text"), model).first().asDict()
        print("\n".join(f"{k}\t{v}" for k, v in report.items()))
    else:
        text = corpus.normalized(rows.select(F.col("value").alias("text"), F.lit(1).cast("bigint").alias("freq")), model.normalizer)
        again, history = continuation.refit(text, model)
        model_files.save(spark, again, args.output)
        print("\n".join(map(str, history)))


if __name__ == "__main__":
    main()
