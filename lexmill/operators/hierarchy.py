"""Continuing merges on whole records under fences and hierarchies, and what identifies the result."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import kept, valid_piece_column
from ..kernels.hierarchy import Record, ScopedProgram, fence_policy, parsed_gates, segmented
from ..kernels.text import Normalizer
from ..session import cut
from ..spec import BOUNDARY, RARE, NormalizerSpec, SpecError, TrainerSpec, need
from .continuation import Piece, Program
from .training import merge_passes, ranked, replay

#: Fixed value: the first line of a hierarchy file ends so.
HEADER = re.compile(r"# [a-z]+-bpe-hierarchy-v([12])")
SIDECAR = "text string, meta string, gates string, ranges string"


def reconciled(base: NormalizerSpec | None, wanted: NormalizerSpec) -> NormalizerSpec:
    """The normal form of a continuation: the base's if the caller asks for none or for an equal one; another is an error."""
    if base is None:
        return wanted
    need(wanted.name in ("", "nmt_nfkc") or wanted == base, f"the normal form {wanted.name!r} isn't the base's {base.name!r}; leave it out to inherit that")
    return base


def read_sidecar(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``text, meta, gates, ranges`` of a hierarchy file, or of several; one line, the first of its file, names the version.

    Version 1 has lines of text and gates, version 2 of text, metadata, gates and ranges, with TAB
    between. Empty lines and comments are skipped, other shapes are errors.
    """
    rows = spark.read.text(path, lineSep="\n")
    first = spark.read.text(path if isinstance(path, str) else path[0], lineSep="\n").first()
    found = first and HEADER.fullmatch(first.value)
    need(found, "the first line of a hierarchy file must name its version")
    fields = 2 if found[1] == "1" else 4
    parts = F.split("value", "\t", -1)
    part = lambda n: F.try_element_at(parts, F.lit(n))
    ok = F.size(parts) == fields if fields == 2 else (F.size(parts) == fields) & (part(2) != "")
    rows = rows.filter((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a line of the hierarchy: "), "value"))))
    if fields == 2:
        return rows.select(part(1).alias("text"), F.lit("").alias("meta"), part(2).alias("gates"), F.lit(None).cast("string").alias("ranges"))
    return rows.select(part(1).alias("text"), part(2).alias("meta"), part(3).alias("gates"), part(4).alias("ranges"))


def with_hierarchy(corpus: DataFrame, sidecar: DataFrame) -> DataFrame:
    """``text, meta, freq, gates, ranges``: each row of the corpus with its line; a missing, second or surplus line is an error."""
    both = corpus.withColumn("__c", F.lit(1)).join(sidecar.withColumn("__s", F.lit(1)), ["text", "meta"], "full_outer")
    n = F.count(F.lit(1)).alias("n")
    twice = sidecar.groupBy("text", "meta").agg(n).filter("n > 1").limit(1).collect()
    need(not twice, "the hierarchy has two lines for a row")
    wrong = F.when(F.col("__c").isNull(), "the hierarchy has a line for no row: ").when(F.col("__s").isNull(), "the hierarchy has no line for a row: ")
    return both.withColumn("freq", F.when(wrong.isNull(), F.col("freq")).otherwise(F.raise_error(F.concat(wrong, "text")).cast("bigint"))).select("text", "meta", "freq", "gates", "ranges")


def normalised_fences(fences: list[str], spec: NormalizerSpec) -> list[str]:
    """Fences in the normal form of the records; an empty one is an error."""
    run = Normalizer(spec)
    out = sorted({run(f) for f in fences})
    need(all(out), "a fence is empty")
    return out


def record_support(rows: DataFrame, fixed: frozenset[str]) -> DataFrame:
    """``left, right, n, applied`` of rows ``symbols, freq, gates, ranges``: the weight of replacements that the hierarchy supports, and of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        supported: Counter = Counter()
        applied: Counter = Counter()
        for b in batches:
            for symbols, freq, gates, ranges in zip(*(c.to_pylist() for c in b.columns)):
                record = Record.of("".join(s for s in symbols if s != BOUNDARY), gates or "", ranges) if gates or ranges is not None else None
                at, last = [0], {}
                for s in symbols:
                    at.append(at[-1] + (0 if s == BOUNDARY else len(s.encode("utf-8", "surrogatepass"))))
                for i, pair in enumerate(zip(symbols, symbols[1:])):
                    if pair[0] in fixed or pair[1] in fixed or last.get(pair, -1) >= i:
                        continue
                    last[pair] = i + 1
                    applied[pair] += freq
                    if record is None or record.supports(at[i], at[i + 2]):
                        supported[pair] += freq
        if applied:
            pairs = list(applied)
            cols = [pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), pa.array([supported[p] for p in pairs], pa.int64()), pa.array(list(applied.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["left", "right", "n", "applied"])

    got = rows.select("symbols", "freq", "gates", "ranges").mapInArrow(count, "left string, right string, n bigint, applied bigint")
    return got.groupBy("left", "right").agg(F.sum("n").cast("bigint").alias("n"), F.sum("applied").cast("bigint").alias("applied")).filter("n > 0")


@dataclass(frozen=True)
class Learnt:
    """What a continuation learnt: the program, each merge with its supported and applied weight, and what identifies the segmented corpus."""

    program: Program
    counts: tuple[tuple[str, str, int, int], ...]
    segmentation: str
    tokens: int
    policy: str = ""


def continue_records(rows: DataFrame, base: Program, new: int, spec: TrainerSpec = TrainerSpec("bpe"), fences: tuple[str, ...] = (), hard_limit: bool = True) -> Learnt:
    """Up to ``new`` merges learnt on whole records ``text, freq`` and maybe ``meta, gates, ranges``, in normal form.

    Inherited merges are applied first. No merge crosses the edge of a fenced string (in normal
    form); with a hierarchy a pair counts where its span is supported, and a learnt merge applies
    everywhere. Ties go to the smaller left, then right piece, by bytes. An empty corpus learns
    nothing; fences and a hierarchy together are an error.
    """
    base = base.checked()
    own = set(rows.columns)
    need(not (fences and {"gates", "ranges"} & own), "fences and a hierarchy can't be combined")
    runtime = base.runtime()
    fixed = frozenset({p.piece for p in base.pieces if not p.mergeable} | {RARE, BOUNDARY})
    ranks = ranked(base.merges)
    fences = tuple(fences)

    @arrow_udf("array<string>")
    def split(texts: pa.Array, gates: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts.to_pylist(), gates.to_pylist()):
            cuts = [c for gate in parsed_gates(g or "") for c in gate.cuts]
            parts = segmented(t, runtime, fences, cuts)
            out.append([*replay(parts, ranks)][-1][1])
        return pa.array(out, pa.list_(pa.string()))

    null = F.lit(None).cast("string")
    extra = [(F.col(c) if c in own else null).alias(c) for c in ("gates", "ranges")]
    meta = (F.col("meta") if "meta" in own else F.lit("")).alias("meta")
    corpus = cut(rows.select("text", meta, F.col("freq").cast("bigint").alias("freq"), *extra).withColumn("symbols", split("text", "gates")))
    usable = lambda s: record_support(s, fixed).filter(valid_piece_column(F.concat("left", "right"), spec))
    first = lambda pairs, n: pairs.orderBy(F.desc("n"), "left", "right").limit(n)
    counts = tuple(merge_passes(corpus, new, usable, first, {p.piece for p in base.pieces}, "applied"))
    need(not hard_limit or len(counts) == new, f"only {len(counts)} of {new} new pieces could be learnt")
    begin = max((p.id for p in base.pieces), default=-1) + 1
    merges = [(a, b) for a, b, *_ in counts]
    program = Program((*base.pieces, *(Piece(begin + n, a + b) for n, (a, b) in enumerate(merges))), (*base.merges, *merges)).checked()
    later = ranked(merges)

    @arrow_udf("array<string>")
    def replayed(batch: pa.Array) -> pa.Array:
        return pa.array([[*replay(s, later)][-1][1] for s in batch.to_pylist()], pa.list_(pa.string()))

    digest, tokens = segmentation_identity(corpus.withColumn("symbols", replayed("symbols")))
    return Learnt(program, counts, digest, tokens, fence_policy(fences) if fences else "")


def segmentation_identity(rows: DataFrame) -> tuple[str, int]:
    """SHA-256 over the segmented rows in the order of their bytes, and the weighted number of tokens.

    A line is the row with its length, weight and token count, then each token with its length.
    Lines are made on the cluster and read in order, a partition at a time.
    """
    live = F.filter("symbols", lambda s: s != BOUNDARY)
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    rows = rows.withColumn("live", live)
    line = F.concat(sized(F.col("text")), F.lit("\t"), F.col("freq").cast("string"), F.lit("\t"), F.size("live").cast("string"), F.array_join(F.transform("live", lambda s: F.concat(F.lit("\t"), sized(s))), ""))
    tokens = rows.agg(F.coalesce(F.sum(F.col("freq") * F.size("live")), F.lit(0)).cast("bigint")).first()[0]
    digest = hashlib.sha256()
    for r in rows.select("text", "meta", line.alias("line")).orderBy("text", "meta").select("line").toLocalIterator():
        digest.update(r.line.encode() + b"\n")
    return digest.hexdigest(), tokens


# --- artifacts ----------------------------------------------------------------------------------


def save_learnt(spark: SparkSession, learnt: Learnt, base: Program, path: str, normalizer: NormalizerSpec, denormalizer: NormalizerSpec | None = None) -> None:
    """A directory with the pieces and merges, inherited and new ones marked, and one line of JSON that says what they belong to."""
    old = {p.id for p in base.pieces}
    score = {a + b: -float(n) for n, (a, b) in enumerate(learnt.program.merges)}
    pieces = [(p.id, p.piece, p.type, p.mergeable, p.atomic, "base" if p.id in old else "new", score.get(p.piece, 0.0)) for p in learnt.program.pieces]
    spark.createDataFrame(pieces, "id int, piece string, type string, mergeable boolean, atomic boolean, origin string, score double").write.mode("overwrite").parquet(f"{path}/pieces")
    weights = {(a, b): (n, used) for a, b, n, used in learnt.counts}
    merges = [(n, a, b, *weights.get((a, b), (None, None)), "new" if (a, b) in weights else "base") for n, (a, b) in enumerate(learnt.program.merges)]
    spark.createDataFrame(merges, "rank int, left string, right string, supported bigint, applied bigint, origin string").write.mode("overwrite").parquet(f"{path}/merges")
    about = {
        "normalizer": asdict(normalizer), "denormalizer": denormalizer and asdict(denormalizer), "base": base.identity(), "program": learnt.program.identity(), "segmentation": learnt.segmentation, "tokens": learnt.tokens, "policy": learnt.policy,
        "learnt": len(learnt.counts),
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_program(spark: SparkSession, path: str) -> tuple[Program, dict]:
    """The program of such a directory and what it says of it; a program that isn't the one named is an error."""
    pieces = [Piece(r.id, r.piece, r.type, r.mergeable, r.atomic) for r in spark.read.parquet(f"{path}/pieces").orderBy("id").collect()]
    merges = [(r.left, r.right) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    out = Program(tuple(pieces), tuple(merges)).checked()
    need(out.identity() == about["program"], "the pieces aren't those that the directory names")
    return out, about


def piece_lines(learnt: Learnt) -> list[str]:
    """Lines of piece, score and id in the order of ids; scores keep all digits of a 32-bit float."""
    score = {a + b: -float(n) for n, (a, b) in enumerate(learnt.program.merges)}
    return [f"{p.piece}\t{score.get(p.piece, 0.0):.9g}\t{p.id}" for p in sorted(learnt.program.pieces, key=lambda p: (p.id, p.piece))]


def encode_expansion(text: str | Column, program: Program, gates: str | Column | None = None, levels: dict[tuple[str, str], int] | None = None) -> Column:
    """ARRAY<INT> of texts in normal form under a ranked program; levels: the level of each merge that is scoped to one, for texts with their gates.

    A null text gives null; a null among the gates stands for none.
    """
    levels = levels or {}
    rows = [(p.id, p.piece, p.type, p.atomic) for p in sorted(program.pieces, key=lambda p: p.id)]
    merges = [(n, a, b, a + b, levels.get((a, b))) for n, (a, b) in enumerate(program.merges)]
    name = hashlib.sha256(json.dumps([rows, merges], ensure_ascii=True).encode()).hexdigest()
    if levels and gates is None:
        raise SpecError("a hierarchical program needs the gates of each text")

    @arrow_udf("array<int>")
    def encode(texts: pa.Array, own: pa.Array) -> pa.Array:
        run = kept(("expansion", name), lambda: ScopedProgram(rows, merges))
        return pa.array([None if t is None else [i for _, _, i in run.encode(t, parsed_gates(g or ""))] for t, g in zip(texts.to_pylist(), own.to_pylist())], pa.list_(pa.int32()))

    col = lambda c: F.col(c) if isinstance(c, str) else c
    return encode(col(text), F.lit(None).cast("string") if gates is None else col(gates))
