"""Continuing vocabularies: merge programs that keep inherited ids, unigram extensions, refits on a fixed vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import kept, valid_piece_column
from ..kernels.hierarchy import fenced
from ..kernels.merges import RankedProgram
from ..kernels.model import Model
from ..kernels.text import valid_piece
from ..kernels.unigram import UnigramKernel
from ..session import cut, tidied
from ..spec import NORMAL, RARE, TYPE_NUMBERS, USER_DEFINED, TrainerSpec, need
from .training import LOCAL_WORDS, expected_counts, joined, merge_passes, prefix_counts, segments_of, words_of


@dataclass(frozen=True)
class Piece:
    id: int
    piece: str
    type: str = NORMAL
    mergeable: bool = True
    atomic: bool = False


@dataclass(frozen=True)
class Program:
    """External pieces with their ids and ranked merges (left, right); a merge's child is its halves put together."""

    pieces: tuple[Piece, ...]
    merges: tuple[tuple[str, str], ...]

    def checked(self) -> Program:
        ids, names = [p.id for p in self.pieces], [p.piece for p in self.pieces]
        need(all(i >= 0 for i in ids) and len(set(ids)) == len(ids), "ids must be 0 or more and each stand once")
        need(all(names) and len(set(names)) == len(names), "pieces must not be empty and each stand once")
        by = {p.piece: p for p in self.pieces}
        for p in self.pieces:
            need(not p.atomic or p.mergeable, f"{p.piece!r} is atomic but not mergeable")
            need(p.type != USER_DEFINED or not (p.mergeable or p.atomic), f"user-defined {p.piece!r} can't be merged")
            need(p.type != NORMAL or not p.mergeable or len(p.piece) > 1 or p.atomic, f"the single character {p.piece!r} must be atomic")
        made = {p.piece for p in self.pieces if p.atomic}
        for left, right in self.merges:
            child = left + right
            need(left in made and right in made, f"a half of {child!r} isn't there yet")
            need(child not in made, f"{child!r} is made twice")
            need(child in by and by[child].mergeable, f"{child!r} is no mergeable piece")
            made.add(child)
        for p in self.pieces:
            need(not p.mergeable or p.type != NORMAL or p.piece in made, f"nothing makes {p.piece!r}")
        return self

    def runtime(self) -> RankedProgram:
        rows = [(p.id, p.piece, p.type, p.atomic) for p in sorted(self.pieces, key=lambda p: p.id)]
        return RankedProgram(rows, [(n, a, b, a + b) for n, (a, b) in enumerate(self.merges)])

    def identity(self) -> str:
        lines = "".join(f"{p.id}\t{p.piece}\t{TYPE_NUMBERS[p.type]}\n" for p in sorted(self.pieces, key=lambda p: p.id))
        return hashlib.sha256(lines.encode()).hexdigest()


def support(rows: Iterable[tuple[list[str], int]]) -> Counter:
    """Weighted counts of neighbours, from the left on, a symbol in one occurrence of a pair only."""
    out: Counter = Counter()
    for symbols, weight in rows:
        last: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(zip(symbols, symbols[1:])):
            if last.get(pair, -1) < i:
                out[pair] += weight
                last[pair] = i + 1
    return out


def support_counts(symbols: DataFrame) -> DataFrame:
    """``left, right, n``: the same as a table, of ``symbols ARRAY<STRING>, freq``; added up in each partition first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            total.update(support(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total]), pa.array([b for _, b in total]), pa.array(list(total.values()), pa.int64())], names=["left", "right", "n"])

    rows = symbols.filter("symbols is not null and freq is not null").select("symbols", F.col("freq").cast("bigint").alias("freq"))
    return rows.mapInArrow(count, "left string, right string, n bigint").groupBy("left", "right").agg(F.sum("n").cast("bigint").alias("n"))


class SupportIndex:
    """Support of pairs over a weighted corpus that merges are applied to."""

    def __init__(self, corpus: list[tuple[list[str], int]]):
        self.rows = corpus
        self.count: Counter = Counter()
        self.at: dict[tuple[str, str], set[int]] = defaultdict(set)
        for n, row in enumerate(corpus):
            for pair, k in support([row]).items():
                self.count[pair] += k
                self.at[pair].add(n)

    def apply(self, pair: tuple[str, str]) -> set[tuple[str, str]]:
        """Merges the pair everywhere; the pairs whose count changed."""
        changed: set[tuple[str, str]] = set()
        for n in list(self.at[pair]):
            symbols, weight = self.rows[n]
            before = support([(symbols, weight)])
            self.rows[n] = (joined(symbols, *pair), weight)
            after = support([self.rows[n]])
            for p in before.keys() | after.keys():
                self.count[p] += after[p] - before[p]
                (self.at[p].add if after[p] else self.at[p].discard)(n)
                changed.add(p)
        return changed


def learn_supported(corpus: list[tuple[list[str], int]], mergeable: set[str], known: set[str], retired: set[tuple[str, str]], new: int, spec: TrainerSpec) -> list[tuple[str, str]]:
    """Up to ``new`` merges by support over weighted segmented words; ties go to the smaller left, then right piece, by bytes."""
    index = SupportIndex(corpus)
    mergeable, known = set(mergeable), set(known)
    heap: list = []

    def offer(pair: tuple[str, str]) -> None:
        a, b = pair
        if index.count[pair] > 0 and pair not in retired and a in mergeable and b in mergeable and a + b not in known and valid_piece(a + b, spec):
            heapq.heappush(heap, (-index.count[pair], a.encode(), b.encode(), pair))

    for pair in index.count:
        offer(pair)
    learnt: list[tuple[str, str]] = []
    while len(learnt) < new and heap:
        n, _, _, pair = heapq.heappop(heap)
        whole = pair[0] + pair[1]
        if whole in known or -n != index.count[pair]:
            offer(pair)  # its count has changed; nothing is offered if its piece is known
            continue
        learnt.append(pair)
        known.add(whole)
        mergeable.add(whole)
        for p in index.apply(pair):
            offer(p)
    return learnt


def continue_pairs(rows: DataFrame, base: Program, new: int, spec: TrainerSpec = TrainerSpec("bpe"), first_id: int | None = None, hard_limit: bool = True, local_words: int = LOCAL_WORDS) -> Program:
    """A program with up to ``new`` more merges, learnt on rows ``text, freq`` segmented by the inherited ones.

    Ties go to the smaller left, then right piece. Inherited ids never change; new ones follow the
    largest. Every new piece is derived again under the final program. The distinct words of the
    corpus are counted before they are taken to the driver; beyond ``local_words`` the same is
    learnt on the cluster.
    """
    base = base.checked()
    runtime = base.runtime() if [p.id for p in sorted(base.pieces, key=lambda p: p.id)] == list(range(len(base.pieces))) else None
    need(runtime is not None, "inherited ids must be dense from 0")
    names = {p.id: p.piece for p in base.pieces}
    mergeable = {p.piece for p in base.pieces if p.mergeable}
    known = {p.piece for p in base.pieces}
    words = words_of(rows, spec)
    taken = words.take(local_words + 1)
    split = lambda word: [names[i] if i != runtime.unknown else RARE for _, _, i in runtime.encode(word)]
    if len(taken) <= local_words:
        learnt = learn_supported([(split(r.word), r.freq) for r in sorted(taken)], mergeable, known, set(base.merges), new, spec)
    else:
        fixed = sorted({p.piece for p in base.pieces if not p.mergeable} | {RARE})

        @arrow_udf("array<string>")
        def segmented(batch: pa.Array) -> pa.Array:
            return pa.array([split(w) for w in batch.to_pylist()], pa.list_(pa.string()))

        def usable(symbols: DataFrame) -> DataFrame:
            pairs = support_counts(symbols).filter(~F.col("left").isin(fixed) & ~F.col("right").isin(fixed))
            return pairs.filter(valid_piece_column(F.concat("left", "right"), spec))

        symbols = cut(words.select(segmented("word").alias("symbols"), "freq"))
        # Inherited merges were applied, so none of their pairs is left; their children are known.
        first = lambda pairs, n: pairs.orderBy(F.desc("n"), "left", "right").limit(n)
        learnt = [(x, y) for x, y, _ in merge_passes(symbols, new, usable, first, set(known))]
    need(not hard_limit or len(learnt) == new, f"only {len(learnt)} of {new} new pieces could be learnt")
    begin = max((p.id for p in base.pieces), default=-1) + 1
    first_id = begin if first_id is None else first_id
    need(first_id >= begin, "new ids must follow the inherited ones")
    out = Program((*base.pieces, *(Piece(first_id + n, a + b) for n, (a, b) in enumerate(learnt))), (*base.merges, *learnt)).checked()
    final = out.runtime() if first_id == begin else None
    for n, (a, b) in enumerate(learnt):
        if final is not None:
            got = final.encode(a + b)
            need([i for _, _, i in got] == [first_id + n], f"{a + b!r} isn't derived again under the final program")
    return out


def splits_of(vocab: DataFrame) -> DataFrame:
    """``piece, left, right``: every way to split a piece into two pieces of the vocabulary."""
    p = F.col("piece")
    cuts = vocab.filter((F.col("type") == NORMAL) & (F.char_length(p) > 1)).select("piece", F.explode(F.sequence(F.lit(1), F.char_length(p) - 1)).alias("k"))
    halves = cuts.select("piece", F.substr(p, F.lit(1), F.col("k")).alias("left"), F.substr(p, F.col("k") + 1).alias("right"))
    names = vocab.filter(F.col("type") == NORMAL).select("piece")
    return halves.join(names.withColumnRenamed("piece", "left"), "left", "left_semi").join(names.withColumnRenamed("piece", "right"), "right", "left_semi").select("piece", "left", "right")


def ambiguous_pieces(vocab: DataFrame) -> DataFrame:
    """``piece, splits`` of pieces with other than one split: scores alone can't stand for their merge program."""
    many = vocab.filter((F.col("type") == NORMAL) & (F.char_length("piece") > 1)).select("piece")
    n = splits_of(vocab).groupBy("piece").agg(F.count(F.lit(1)).alias("splits"))
    return many.join(n, "piece", "left").select("piece", F.coalesce("splits", F.lit(0)).cast("bigint").alias("splits")).filter("splits <> 1")


# --- unigram ------------------------------------------------------------------------------------


def candidates(rows: DataFrame, inherited: DataFrame, spec: TrainerSpec = TrainerSpec(), most: int | None = 1_000_000, least: int = 2) -> DataFrame:
    """``piece, n``: the best substrings of rows ``text, freq`` that aren't inherited, by count times length; all of them if most is None."""
    texts = rows.groupBy("text").agg(F.sum("freq").alias("freq")).select("text", "freq", F.lit("\0").alias("end"))
    counted = prefix_counts(texts, spec.max_piece_length, least)
    fresh = counted.join(inherited.select("piece"), "piece", "left_anti").filter(valid_piece_column("piece", spec))
    if most is None:
        return fresh
    return fresh.orderBy((F.col("n") * F.char_length("piece")).desc(), F.char_length("piece").desc(), "piece").limit(most)


def bisect(what: str, f: Callable[[float], float], low: float, high: float, increasing: bool = True) -> float:
    """The root of a monotone function; a bracket that can't be found and values that aren't finite are errors."""
    g = f if increasing else (lambda x: -f(x))
    for _ in range(400):
        if g(low) <= 0:
            break
        low, high = low - max(1.0, abs(low)), low
    for _ in range(400):
        if g(high) >= 0:
            break
        low, high = high, high + max(1.0, abs(high))
    need(all(map(math.isfinite, (g(low), g(high)))), f"{what}: not finite")
    need(g(low) <= 0 <= g(high), f"{what}: no change of sign")
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (mid, high) if g(mid) < 0 else (low, mid)
    return (low + high) / 2


def base_mass(scores: np.ndarray, lengths: np.ndarray, gauge: float) -> float:
    """The log of the inherited pieces' mass when each score is shifted by the gauge times its length."""
    shifted = scores + gauge * lengths
    top = shifted.max() if len(shifted) else -math.inf
    return float(top + np.log(np.exp(shifted - top).sum())) if top > -math.inf else -math.inf


def solve_gauge(scores: np.ndarray, lengths: np.ndarray, mass: float) -> float:
    """The gauge under which the inherited pieces hold the mass, between 0 and 1."""
    need(0 < mass < 1, "the mass must lie between 0 and 1")
    return bisect("gauge", lambda g: base_mass(scores, lengths, g) - math.log(mass), -1.0, 1.0)


#: The log of an inherited mass that stands for none at all.
NO_MASS = math.log(1e-30)


def stationary_gauge(scores: np.ndarray, lengths: np.ndarray, inherited: float, fresh: float) -> float:
    """The gauge g at which inherited * g + fresh * log(1 - mass(g)) is largest.

    inherited: expected letters of inherited pieces; fresh: expected count of new ones. Without new
    ones all mass is inherited, without inherited ones next to none.
    """
    need(math.isfinite(inherited) and math.isfinite(fresh) and inherited >= 0 and fresh >= 0, "expected counts must be finite")
    most = bisect("largest gauge", lambda g: base_mass(scores, lengths, g), -1.0, 1.0)
    if fresh <= 1e-30:
        return most
    if inherited <= 1e-30:
        return bisect("least gauge", lambda g: base_mass(scores, lengths, g) - NO_MASS, most - 1, most)

    def slope(g: float) -> float:
        mass = np.exp(scores + g * lengths)
        left = 1 - mass.sum()
        return inherited - fresh * float((lengths * mass).sum()) / left if left > 0 else -math.inf

    high = most - 1e-10
    return bisect("gauge of a step", slope, high - 1, high, increasing=False)


def prefix_faults(prior: DataFrame, output: DataFrame, gauge: float, tolerance: float = 1e-4) -> DataFrame:
    """``piece_id, fault`` of inherited pieces that an extension changed: missing, another string or type, a score off the gauge."""
    new = output.select("piece_id", F.col("piece").alias("new_piece"), F.col("score").alias("new_score"), F.col("type").alias("new_type"))
    both = prior.join(new, "piece_id", "left")
    wanted = F.when(F.col("type") == NORMAL, F.col("score").cast("double") + gauge * F.char_length("piece")).otherwise(F.col("score").cast("double"))
    fault = (
        F.when(F.col("new_piece").isNull(), "missing").when(F.col("new_piece") != F.col("piece"), "piece").when(F.col("new_type") != F.col("type"), "type")
        .when(F.abs(F.col("new_score").cast("double") - wanted) > tolerance, "score")
    )
    return both.select("piece_id", fault.alias("fault")).filter("fault is not null")


def uncovered(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``piece, n``: the characters of rows ``text, freq`` that aren't pieces, which an extension needs."""
    letters = rows.select(F.explode(F.split("text", "", -1)).alias("piece"), "freq").filter("piece <> ''").groupBy("piece").agg(F.sum("freq").cast("bigint").alias("n"))
    return letters.join(vocabulary.select("piece"), "piece", "left_anti")


def unfenced_stretches(text: str | Column, fences: list[str]) -> Column:
    """ARRAY<STRING>: what is left of a text between fenced stretches, which no candidate may touch."""

    @arrow_udf("array<string>")
    def left(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch.to_pylist():
            edges = [e for stretch in fenced(t, fences) for e in stretch] if t is not None else []
            out.append(None if t is None else [t[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(t)]) if a < b])
        return pa.array(out, pa.list_(pa.string()))

    return left(F.col(text) if isinstance(text, str) else text)


def on_basis(found: DataFrame, own: list[tuple[str, float]], required: list[tuple[str, float]]) -> list[tuple[str, float, int]]:
    """(piece, score, inherited letters) of candidates ``piece``: their best path over inherited pieces and required characters. Those without one are left out."""
    free, name = {p for p, _ in required}, uuid4().hex
    pieces = [("<unk>", 0.0, "UNKNOWN"), *((p, s, NORMAL) for p, s in (*own, *required))]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = kept(("basis", name), lambda: UnigramKernel(pieces))
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                path, score = kernel.best(p)
                if all(i != kernel.unknown for _, _, i in path):
                    rows.append((p, score, sum(end - begin for begin, end, _ in path if p[begin:end] not in free)))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int32())], names=["piece", "score", "letters"])

    return sorted((r.piece, r.score, r.letters) for r in found.select("piece").mapInArrow(spell, "piece string, score double, letters int").collect())  # at most the seeds


def continue_unigram(rows: DataFrame, prior: Model, new: int, spec: TrainerSpec | None = None, hard_limit: bool = True, fences: tuple[str, ...] = ()) -> tuple[Model, float]:
    """A unigram model with ``new`` more pieces, and the gauge its inherited scores were shifted by.

    rows: ``text, freq`` in normal form. Inherited pieces keep ids, strings and types, and the
    scores of normal ones move by one gauge times their length. Characters that they can't spell
    are required: they share the mass that the prior leaves, by frequency, and no candidate
    replaces them. Other candidates begin tied to their best path over this basis. Each step takes
    expected counts, sets the gauge where the likelihood is stationary, and shares the rest of the
    mass among the new pieces; the least expected ones go until ``new`` are left. Candidates touch
    neither the prior's special symbols nor fences. Fewer candidates than ``new`` are an error
    under the hard limit, and so is a prior without free mass where characters are required.
    """
    need(prior.trainer.model_type == "unigram", "the prior must be a unigram model")
    need(new >= 0, "the number of new pieces must be 0 or more")
    spec = spec or prior.trainer
    spark = rows.sparkSession
    own = [(p, s) for p, s, t in prior.pieces if t == NORMAL]
    need(own and all(math.isfinite(s) for _, s in own), "the prior has no normal piece, or one without a finite score")
    scores, lengths = np.array([s for _, s in own]), np.array([len(p) for p, _ in own], float)
    with tidied(spark):
        words = cut(words_of(rows, spec).select(F.col("word").alias("text"), "freq"))
        spelled = spark.createDataFrame([(p,) for p, _, t in prior.pieces if t in (NORMAL, USER_DEFINED)], "piece string")
        missing = sorted(((r.piece, r.n) for r in uncovered(words, spelled).collect()), key=lambda x: (-x[1], x[0]))  # at most all of Unicode
    need(len(missing) <= new, f"{len(missing)} characters need pieces of their own")
    if not new:
        return prior, 0.0
    left = 1 - math.exp(min(0.0, base_mass(scores, lengths, 0.0)))
    need(not missing or left > 0, "the prior leaves no mass for the characters that it can't spell")
    whole = sum(n for _, n in missing)
    required = [(p, math.log(left * n / whole)) for p, n in missing]
    marks = sorted({p for p, _, t in prior.pieces if t not in (NORMAL, "UNUSED")} | set(fences))
    view = words.select(F.explode(unfenced_stretches("text", marks)).alias("text"), "freq")
    inherited = spark.createDataFrame([(p,) for p, _, _ in prior.pieces], "piece string")
    with tidied(spark):
        if spec.split_by_whitespace:  # then no valid piece goes beyond a stretch, and there are far fewer of them than words
            view = segments_of(view.withColumnRenamed("text", "word"), spec).withColumnRenamed("word", "text")
        pool = on_basis(candidates(view, inherited, spec, max(new, spec.seed_size)), own, required)
    need(not hard_limit or len(pool) + len(required) >= new, f"only {len(pool) + len(required)} of {new} new pieces can be spelled by the prior")

    # The basis and the tied candidates hold all mass together.
    tied, exposed = np.array([s for _, s, _ in pool]), np.array([h for *_, h in pool], float)
    fixed = np.array([s for _, s in required])
    everything, exposure = np.concatenate((scores, tied, fixed)), np.concatenate((lengths, exposed, np.zeros(len(fixed))))
    gauge = bisect("gauge of the basis", lambda g: base_mass(everything, exposure, g), -1.0, 1.0)
    names = [p for p, _ in required] + [p for p, *_ in pool]
    fresh = np.concatenate((fixed, tied + gauge * exposed))
    must = len(required)

    def expected() -> np.ndarray:
        pieces = list(zip((p for p, _ in own), (scores + gauge * lengths).tolist())) + list(zip(names, fresh.tolist()))
        return expected_counts(words, pieces)[0]

    def shared(counts: np.ndarray) -> np.ndarray:
        counts = np.maximum(counts, 1e-30)
        return math.log(max(1e-300, 1 - math.exp(base_mass(scores, lengths, gauge)))) + np.log(counts / counts.sum())

    def step() -> np.ndarray:
        nonlocal gauge, fresh
        counts = expected()
        gauge = stationary_gauge(scores, lengths, float((counts[: len(own)] * lengths).sum()), float(counts[len(own) :].sum()))
        need(counts[len(own) :].sum() > 0, "the new pieces are never used")
        fresh = shared(counts[len(own) :])
        return counts[len(own) :]

    while len(names) > new:
        for _ in range(spec.num_sub_iterations):
            counts = step()
        keep = max(new, must, min(len(names) - 1, int(len(names) * spec.shrinking_factor)))
        order = [*range(must), *sorted(range(must, len(names)), key=lambda i: (-round(counts[i], 9), names[i]))][:keep]
        names, fresh = [names[i] for i in order], shared(counts[order])
    for _ in range(max(2, spec.num_sub_iterations)):
        counts = step()
    need(not hard_limit or bool((counts > 0).all()), "some of the new pieces are never expected")
    last = sorted(zip(names, fresh.tolist()), key=lambda x: (-round(x[1], 9), x[0]))
    rest = [(p, s + gauge * len(p) if t == NORMAL else s, t) for p, s, t in prior.pieces]
    model = Model((*rest, *((p, s, NORMAL) for p, s in last)), prior.trainer, prior.normalizer, prior.denormalizer).checked()
    # The last gate: the corpus can be spelled.
    known = spark.createDataFrame([(p,) for p, _, t in model.pieces if t in (NORMAL, USER_DEFINED)], "piece string")
    need(not uncovered(words, known).limit(1).collect(), "the model can't spell its corpus")
    return model, gauge


def refit(rows: DataFrame, model: Model, iterations: int = 8, floor: float = 1e-30) -> tuple[Model, list[float]]:
    """The same pieces with scores fitted to rows ``text, freq`` in normal form, and the likelihood before each step.

    Text that the pieces can't spell is an error, and so is a likelihood that gets worse.
    """
    need(model.trainer.model_type == "unigram", "a refit needs a unigram model")
    need(iterations >= 1 and 0 < floor <= 1e-6, "iterations must be 1 or more, the floor above 0 and 1e-6 at most")
    at = [i for i, (_, _, t) in enumerate(model.pieces) if t == NORMAL]
    need(at, "the model has no normal piece")
    pieces = [(model.pieces[i][0], model.pieces[i][1]) for i in at]
    loop = cut(rows.groupBy("text").agg(F.sum("freq").cast("bigint").alias("freq")))
    history: list[float] = []
    for _ in range(iterations):
        counts, likelihood = expected_counts(loop, pieces, known_only=True)
        need(len(history) < 2 or likelihood >= history[-1] - 1e-6 * abs(history[-1]), "the likelihood got worse")
        history.append(likelihood)
        total = counts.sum()
        pieces = [(p, math.log(max(n / total, floor))) for (p, _), n in zip(pieces, counts)]
    scores = dict(zip(at, (s for _, s in pieces)))
    return Model(tuple((p, scores.get(i, s), t) for i, (p, s, t) in enumerate(model.pieces)), model.trainer, model.normalizer, model.denormalizer), history
