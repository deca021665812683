"""Learning vocabularies: characters, words, merged pairs, unigram language models.

Corpora are aggregated on the cluster; what a training loop keeps on the driver is bounded by its
options (the alphabet, the seeds, the vocabulary) or checked before (the distinct words of the
merge trainer, which has a distributed loop beyond the bound).
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import normalize_column, valid_piece_column, words_column
from ..kernels.model import Model, assemble, special_layout
from ..kernels.text import script, valid_piece
from ..kernels.unigram import Trainable, UnigramKernel, digamma
from ..session import cut
from ..spec import NORMAL, RARE, SPACE, UNKNOWN, NormalizerSpec, TrainerSpec, need
from .corpus import head, masked, normalized, sample, usable, weighted
from .vocabulary import alphabet, char_histogram

#: Distinct words, or stretches of them, up to which pairs are merged on the driver.
LOCAL_WORDS = 2_000_000


def training_rows(df: DataFrame, spec: TrainerSpec, normalizer: NormalizerSpec) -> DataFrame:
    """``text, freq``: usable rows, sampled, normalised, with symbols and delimiters as boundaries.

    df: ``text`` and maybe ``freq``. Null and empty texts, over-long ones and such with the sign
    for rare characters are left out; equal rows stay apart.
    """
    rows = weighted(df) if "freq" in df.columns else df.select("text", F.lit(1).cast("bigint").alias("freq"))
    rows = usable(rows, spec.max_sentence_length)
    if spec.input_sentence_size:
        # The first rows as they are read; the order within and between files is that of the scan.
        rows = sample(rows, spec.input_sentence_size) if spec.shuffle_input_sentence else head(rows.withColumn("__nth", F.monotonically_increasing_id()), spec.input_sentence_size, "__nth").drop("__nth")
    symbols = tuple(p for p, k in special_layout(spec).values() if k != "BYTE")
    form = NormalizerSpec(normalizer.name, normalizer.rules, normalizer.add_dummy_prefix, normalizer.remove_extra_whitespaces, normalizer.escape_whitespaces, spec.whitespace_as_suffix)
    rows = normalized(rows, form, spec.user_defined_symbols)
    rows = masked(rows, list(symbols))
    if spec.pretokenization_delimiter:
        rows = rows.withColumn("text", F.replace("text", F.lit(spec.pretokenization_delimiter), F.lit("\x1f")))
    return rows


def covered(rows: DataFrame, spec: TrainerSpec) -> tuple[DataFrame, list[tuple[str, int]]]:
    """rows with uncovered characters masked, and the covered ones with their counts, most frequent first."""
    histogram = char_histogram(rows, "text", "freq").filter(F.col("char") != "\x1f")
    found = alphabet(histogram, spec.character_coverage, spec.required_chars, spec.use_all_vocab).select("char", "freq", "kept").collect()  # at most all of Unicode
    chars = sorted(((r.char, r.freq) for r in found if r.kept), key=lambda x: (-x[1], x[0]))
    rare = "".join(r.char for r in found if not r.kept)
    return rows.withColumn("text", F.translate("text", rare, RARE * len(rare))) if rare else rows, chars


def logs(counts: list[tuple[str, int]], total: int) -> list[tuple[str, float]]:
    return [(p, float(np.float32(math.log(n) - math.log(total)))) for p, n in counts if n > 0]


def train_chars(df: DataFrame, spec: TrainerSpec, normalizer: NormalizerSpec = NormalizerSpec()) -> Model:
    rows = training_rows(df, spec, normalizer)
    _, chars = covered(rows, spec)
    total = sum(n for _, n in chars)
    return assemble(spec, logs(chars, total), normalizer)


def train_words(df: DataFrame, spec: TrainerSpec, normalizer: NormalizerSpec = NormalizerSpec()) -> Model:
    """The most frequent words; those with rare characters count in the total only."""
    rows, _ = covered(training_rows(df, spec, normalizer), spec)
    table = words_of(rows, spec)
    total = table.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    clean = table.filter(~F.contains("word", F.lit(RARE)))
    room = max(0, spec.vocab_size - len(special_layout(spec)))
    if not spec.use_all_vocab:
        clean = clean.orderBy(F.col("freq").desc(), "word").limit(room)
    best = sorted(((r.word, r.freq) for r in clean.collect()), key=lambda x: (-x[1], x[0]))
    return assemble(spec, logs(best, total), normalizer)


def words_of(rows: DataFrame, spec: TrainerSpec) -> DataFrame:
    """``word, freq`` of rows ``text, freq``; no word crosses a boundary."""
    parts = F.split("text", "\x1f", -1)
    if spec.split_by_whitespace or spec.split_by_interval or spec.split_by_barline:
        own = lambda p: words_column(p, spec.whitespace_as_suffix, spec.allow_whitespace_only, spec.split_by_interval, spec.split_by_barline)
        words = F.flatten(F.transform(parts, own))
    else:
        words = F.filter(parts, lambda p: p != "")
    return rows.select(F.explode(words).alias("word"), "freq").groupBy("word").agg(F.sum("freq").cast("bigint").alias("freq"))


# --- pairs ------------------------------------------------------------------------------------


def symbols_of(words: DataFrame) -> DataFrame:
    """``symbols ARRAY<STRING>, freq`` of ``word, freq``."""
    return words.select(F.filter(F.split("word", "", -1), lambda c: c != "").alias("symbols"), "freq")


def pair_counts(symbols: DataFrame) -> DataFrame:
    """``left, right, n``: weighted counts of neighbours, overlapping ones each."""
    s = F.col("symbols")
    pairs = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.element_at(s, i).alias("left"), F.element_at(s, i + 1).alias("right")))
    rows = symbols.filter(F.size(s) > 1).select(F.explode(pairs).alias("p"), "freq")
    return rows.groupBy("p.left", "p.right").agg(F.sum("freq").cast("bigint").alias("n"))


def valid_pairs(pairs: DataFrame, spec: TrainerSpec) -> DataFrame:
    return pairs.filter((F.col("left") != RARE) & (F.col("right") != RARE)).filter(valid_piece_column(F.concat("left", "right"), spec))


def first_pair(pairs: DataFrame, n: int = 1) -> DataFrame:
    """The pairs to merge first: the most frequent, then the shorter, then the smaller."""
    whole = F.concat("left", "right")
    return pairs.orderBy(F.col("n").desc(), F.char_length(whole), whole, F.char_length("left")).limit(n)


def joined(symbols: list[str], left: str, right: str) -> list[str]:
    """symbols with neighbours left, right joined from the left on, never overlapping."""
    out, i, n = [], 0, len(symbols)
    while i < n:
        if i + 1 < n and symbols[i] == left and symbols[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def pair_applied(symbols: str | Column, left: str, right: str) -> Column:
    """The same on a column of ARRAY<STRING>. The column is named once, so that chains of merges stay linear."""

    @arrow_udf("array<string>")
    def apply(batch: pa.Array) -> pa.Array:
        return pa.array([None if s is None else joined(s, left, right) for s in batch.to_pylist()], pa.list_(pa.string()))

    return apply(F.col(symbols) if isinstance(symbols, str) else symbols)


def segments_of(words: DataFrame, spec: TrainerSpec) -> DataFrame:
    """``word, freq``: the stretches of words that no valid piece goes beyond, equal ones added up; single characters are left out.

    Merges over these are those over the words, and there are far fewer of them.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            total: Counter = Counter()
            for word, freq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                begin = 0
                for i in range(1, len(word)):
                    pair = word[i - 1 : i + 1]
                    apart = known.get(pair)
                    if apart is None:
                        # A mark takes the script of the character before it, so what it goes with isn't known from two.
                        apart = known[pair] = script(pair[0]) != "Inherited" and not valid_piece(pair, spec)
                    if apart:
                        if i - begin > 1:
                            total[word[begin:i]] += freq
                        begin = i
                if len(word) - begin > 1:
                    total[word[begin:]] += freq
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "freq"])

    return words.mapInArrow(parts, "word string, freq bigint").groupBy("word").agg(F.sum("freq").cast("bigint").alias("freq"))


class PairLearner:
    """Learns merges over weighted words in flat arrays, keeping each pair's places at hand.

    A place is that of a symbol's first character; neighbours are linked, and -1 is no neighbour.
    Places of a pair are looked at again when it is merged, as others may have changed them.
    """

    def __init__(self, words: Iterable[tuple[str, int]], spec: TrainerSpec):
        self.spec = spec
        names, weights = [], []
        for word, weight in words:
            names.append(word)
            weights.append(weight)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        text = "".join(names)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        del names, text
        letters, ids = np.unique(chars, return_inverse=True)
        del chars
        self.names = [chr(c) for c in letters.tolist()]
        self.number = {p: i for i, p in enumerate(self.names)}
        self.symbol = ids.astype(np.int32)
        size = len(ids)
        self.weight = np.repeat(np.array(weights, np.int64), sizes)
        self.after, self.before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        ends = np.cumsum(sizes)[sizes > 0]
        self.after[ends - 1] = -1
        self.before[(ends - sizes[sizes > 0])] = -1
        self.count: dict[int, int] = {}
        self.at: dict[int, list[np.ndarray]] = {}
        self.ok: dict[str, bool] = {}
        self.heap: list = []
        self.retired: set[int] = set()
        places = np.flatnonzero(self.after >= 0).astype(np.int32)
        self.add(places, self.codes(places))

    def codes(self, places: np.ndarray) -> np.ndarray:
        """The number of the pair at each place."""
        return self.symbol[places].astype(np.int64) << 32 | self.symbol[self.after[places]]

    def add(self, places: np.ndarray, codes: np.ndarray) -> None:
        """Counts new places of pairs and offers the pairs."""
        if not len(places):
            return
        order = np.argsort(codes, kind="stable")
        places, codes = places[order], codes[order]
        begin = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        totals = np.add.reduceat(self.weight[places], begin).tolist()
        edges = [*begin.tolist(), len(places)]
        for k, (code, n) in enumerate(zip(codes[begin].tolist(), totals)):
            self.count[code] = self.count.get(code, 0) + n
            self.at.setdefault(code, []).append(places[edges[k] : edges[k + 1]])
            self.offer(code)

    def pair(self, code: int) -> tuple[str, str]:
        return self.names[code >> 32], self.names[code & 0xFFFFFFFF]

    def allowed(self, left: str, right: str) -> bool:
        if RARE in (left, right):
            return False
        whole = left + right
        if whole not in self.ok:
            self.ok[whole] = valid_piece(whole, self.spec)
        return self.ok[whole]

    def offer(self, code: int) -> None:
        left, right = self.pair(code)
        if code not in self.retired and self.allowed(left, right):
            heapq.heappush(self.heap, (-self.count[code], len(left + right), left + right, len(left), code))

    def apply(self, left: str, right: str) -> int:
        """Merges the pair everywhere; how many symbols that saves, by weight."""
        a, b = self.number.get(left, -1), self.number.get(right, -1)
        code = a << 32 | b
        if a < 0 or b < 0 or code not in self.at:
            return 0
        at = np.unique(np.concatenate(self.at.pop(code)))
        at = at[(self.symbol[at] == a) & (self.after[at] >= 0)]
        at = at[self.symbol[self.after[at]] == b]
        if a == b and len(at):  # from the left on, never overlapping: every other place of a run
            follows = np.concatenate(([False], self.after[at[:-1]] == at[1:]))
            run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if not len(at):
            return 0
        gone = self.after[at]
        touched = np.unique(np.concatenate((self.before[at], at, gone)))
        touched = touched[(touched >= 0)]
        touched = touched[self.after[touched] >= 0]
        codes = self.codes(touched)
        found, where = np.unique(codes, return_inverse=True)
        lost = np.zeros(len(found), np.int64)
        np.add.at(lost, where, self.weight[touched])
        for c, n in zip(found.tolist(), lost.tolist()):
            self.count[c] -= n
        whole = left + right
        if whole not in self.number:
            self.number[whole] = len(self.names)
            self.names.append(whole)
        self.symbol[at], self.symbol[gone] = self.number[whole], -1
        nexts = self.after[gone]
        self.after[at] = nexts
        self.after[gone] = -1
        there = nexts >= 0
        self.before[nexts[there]] = at[there]
        made = np.unique(np.concatenate((self.before[at], at)))
        made = made[made >= 0]
        made = made[self.after[made] >= 0]
        self.add(made, self.codes(made))
        return int(self.weight[at].sum())

    def learn(self, most: int, known: Iterable[str] = (), first: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str]]:
        """Up to ``most`` merges. Pairs that no longer occur stay candidates and fill up what room is left."""
        out: list[tuple[str, str]] = []
        learnt = set(known)
        for left, right in first:
            if left in self.number and right in self.number:
                self.retired.add(self.number[left] << 32 | self.number[right])
            self.apply(left, right)
            learnt.add(left + right)
            out.append((left, right))
        while len(out) < most and self.heap:
            n, _, whole, _, code = heapq.heappop(self.heap)
            if code in self.retired:
                continue
            if -n != self.count[code]:
                self.offer(code)
                continue
            self.retired.add(code)
            if whole in learnt:
                continue
            learnt.add(whole)
            out.append(self.pair(code))
            self.apply(*out[-1])
        return out


def replay(word: list[str], ranks: dict[tuple[str, str], int]) -> Iterator[tuple[int, list[str]]]:
    """The states of a word while merges are applied in order: -1 and the word itself, then each merge that changes it."""
    at = -1
    yield at, word
    while (at := min((n for p in zip(word, word[1:]) if (n := ranks.get(p, -1)) > at), default=-1)) >= 0:
        pair = next(p for p in zip(word, word[1:]) if ranks.get(p) == at)
        word = joined(word, *pair)
        yield at, word


def ranked(merges: Iterable[tuple[str, str]]) -> dict[tuple[str, str], int]:
    out: dict[tuple[str, str], int] = {}
    for n, pair in enumerate(merges):
        out.setdefault(pair, n)
    return out


def pairs_met(symbols: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """``left, right``: every pair that occurs before, between or after the merges."""
    ranks = ranked(merges)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {p for word in b.column(0).to_pylist() for _, state in replay(word, ranks) for p in zip(state, state[1:])}
            yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in found], pa.string()) for n in (0, 1)], names=["left", "right"])

    return symbols.select("symbols").mapInArrow(met, "left string, right string").distinct()


#: Candidates looked at in a pass over the words, and passes between cuts of the lineage.
WINDOW, EVERY = 512, 4


def new_neighbours(symbols: DataFrame, pairs: list[tuple[str, str]]) -> dict[int, int]:
    """For each pair the most often that one neighbour stands beside it: no pair that its merge makes can be more frequent."""
    number = {p: n for n, p in enumerate(pairs)}

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for word, freq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, p in enumerate(zip(word, word[1:])):
                    n = number.get(p)
                    if n is not None:
                        if i:
                            total[n, 0, word[i - 1]] += freq
                        if i + 2 < len(word):
                            total[n, 1, word[i + 2]] += freq
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys]), pa.array(list(total.values()), pa.int64())], names=["pair", "side", "symbol", "n"])

    rows = symbols.select("symbols", "freq").mapInArrow(beside, "pair int, side int, symbol string, n bigint").groupBy("pair", "side", "symbol").agg(F.sum("n").alias("n"))
    return {r.pair: r.n for r in rows.groupBy("pair").agg(F.max("n").alias("n")).collect()}


def all_applied(symbols: str | Column, merges: list[tuple[str, str]]) -> Column:
    """Several merges that share no symbol, in one pass."""
    wanted = frozenset(merges)

    def done(word: list[str]) -> list[str]:
        for pair in wanted.intersection(zip(word, word[1:])) if len(word) > 1 else ():
            word = joined(word, *pair)
        return word

    @arrow_udf("array<string>")
    def apply(batch: pa.Array) -> pa.Array:
        return pa.array([None if s is None else done(s) for s in batch.to_pylist()], pa.list_(pa.string()))

    return apply(F.col(symbols) if isinstance(symbols, str) else symbols)


def merge_passes(symbols: DataFrame, most: int, pairs_of: Callable[[DataFrame], DataFrame], first: Callable[[DataFrame, int], DataFrame], learnt: set[str], also: str | None = None) -> Iterator[tuple]:
    """Merges with their counts, in exactly the order in which they would be learnt one at a time, as many a pass as that allows.

    pairs_of: the candidates ``left, right, n`` of symbols; first: the best n of them in order;
    learnt: pieces that aren't learnt again, to which the new ones are added; also: a column of
    the candidates that comes after the count. A pass takes the
    best candidates as long as they share no symbol with those before, so that their counts still
    hold, and are more frequent than any pair that the merges before can make.
    """
    passes = made = 0
    while made < most:
        pairs, n = pairs_of(symbols), WINDOW + len(learnt)  # bounded by the vocabulary, but for pairs that make the same piece
        while True:
            found = first(pairs, n).collect()
            fresh = [(r.left, r.right, r.n, *([r[also]] if also else [])) for r in found if r.left + r.right not in learnt]
            if fresh or len(found) < n:
                break
            n *= 2
        fresh = [x for x in fresh if x[2] > 0][: min(WINDOW, most - made)]
        if not fresh:
            return
        limit = new_neighbours(symbols, [x[:2] for x in fresh]) if len(fresh) > 1 else {}
        chosen: list[tuple[str, str]] = []
        touched: set[str] = set()
        bound = -1
        for k, (a, b, n, *rest) in enumerate(fresh):
            if a + b in learnt:  # made by another pair of this pass
                continue
            if chosen and (a in touched or b in touched or n <= bound):
                break
            learnt.add(a + b)
            chosen.append((a, b))
            touched |= {a, b}
            bound = max(bound, limit.get(k, 0))
            made += 1
            yield a, b, n, *rest
        symbols = symbols.withColumn("symbols", all_applied("symbols", chosen))
        passes += 1
        if passes % EVERY == 0:
            symbols = cut(symbols)


def learn_distributed(words: DataFrame, spec: TrainerSpec, most: int, known: Iterable[str] = (), first: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """The same as PairLearner.learn on the cluster, many merges a pass where they don't touch each other."""
    whole = cut(symbols_of(words))
    symbols, out, learnt = whole, list(first), set(known)
    learnt |= {a + b for a, b in out}
    if out:
        ranks = ranked(out)

        @arrow_udf("array<string>")
        def last(batch: pa.Array) -> pa.Array:
            return pa.array([None if s is None else [*replay(s, ranks)][-1][1] for s in batch.to_pylist()], pa.list_(pa.string()))

        symbols = cut(symbols.withColumn("symbols", last("symbols")))
    out += [(a, b) for a, b, _ in merge_passes(symbols, most - len(out), lambda s: valid_pairs(pair_counts(s), spec), first_pair, learnt)]
    if len(out) < most:  # pairs that no longer occur fill up what room is left
        gone = cut(valid_pairs(pairs_met(whole, out), spec).withColumn("n", F.lit(0).cast("bigint")))
        n = most
        while True:
            more = first_pair(gone, n).collect()
            fill = {r.left + r.right: (r.left, r.right) for r in reversed(more) if r.left + r.right not in learnt}
            if len(fill) >= most - len(out) or len(more) < n:
                break
            n *= 2
        out += sorted(fill.values(), key=lambda p: (len(p[0] + p[1]), p[0] + p[1]))[: most - len(out)]
    return out


def train_pairs(df: DataFrame, spec: TrainerSpec, normalizer: NormalizerSpec = NormalizerSpec(), seed_merges: tuple[tuple[str, str], ...] = (), protected: tuple[str, ...] = (), local_words: int = LOCAL_WORDS) -> tuple[Model, list[tuple[str, str]]]:
    """A merge vocabulary and its merges in order. Scores are the negated positions; characters follow the merges."""
    rows, chars = covered(training_rows(df, spec, normalizer), spec)
    words = cut(segments_of(words_of(rows, spec), spec))
    room = spec.vocab_size - len(special_layout(spec)) - len(protected)
    whole = spec.auto_character_coverage
    budget = room if whole else room - len(chars)
    need(budget >= 0, f"vocabulary of {spec.vocab_size} is too small for {len(chars)} characters")
    few = words.count() <= local_words
    if few:
        merges = PairLearner(gathered(words), spec).learn(budget, protected, seed_merges)
    else:
        merges = learn_distributed(words, spec, budget, known=protected, first=seed_merges)
    names = [c for c, _ in chars]
    if whole:
        k, names = best_mixture(merge_gains(merges, gathered(words)) if few else merge_gains_distributed(merges, words), [(c, n) for c, n in chars], room)
        merges = merges[:k]
    order = list(dict.fromkeys([*protected, *(a + b for a, b in merges), *names]))
    return assemble(spec, [(p, -float(i)) for i, p in enumerate(order)], normalizer), merges


def gathered(words: DataFrame) -> Iterator[tuple[str, int]]:
    """``word, freq`` as pairs, of which Python holds a batch at a time."""
    for b in words.select("word", "freq").toArrow().to_batches():
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


def merge_gains(merges: list[tuple[str, str]], words: Iterable[tuple[str, int]]) -> list[int]:
    """How many symbols each merge saves over the weighted words, when applied in order."""
    learner = PairLearner(words, TrainerSpec())
    return [learner.apply(*pair) for pair in merges]


def merge_gains_distributed(merges: list[tuple[str, str]], words: DataFrame) -> list[int]:
    """The same over all of ``word, freq`` on the cluster."""
    ranks = ranked(merges)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for word, freq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                before = len(word)
                for n, state in replay(word, ranks):
                    if n >= 0:
                        total[n] += (before - len(state)) * freq
                    before = len(state)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["n", "gain"])

    out = [0] * len(merges)
    for r in symbols_of(words).mapInArrow(gains, "n int, gain bigint").groupBy("n").agg(F.sum("gain").alias("gain")).collect():  # one row a merge
        out[r.n] = r.gain
    return out


def best_mixture(gains: list[int], chars: list[tuple[str, int]], room: int) -> tuple[int, list[str]]:
    """How many merges and which characters of several bytes fill the room best, when bytes stand for the rest.

    A character saves its count times its bytes less one. Of equal mixtures the one with more
    merges is taken.
    """
    worth = sorted(((n * (len(c.encode()) - 1), c) for c, n in chars if not c.isascii()), key=lambda x: (-x[0], x[1]))
    saved = np.concatenate(([0], np.cumsum([w for w, _ in worth])))
    merged = np.concatenate(([0], np.cumsum(gains)))
    best, choice = -1, 0
    for k in range(min(len(gains), room) + 1):
        total = merged[k] + saved[min(len(worth), room - k)]
        if total >= best:
            best, choice = total, k
    return choice, [c for _, c in worth[: room - choice]]


# --- unigram ----------------------------------------------------------------------------------


#: Characters of a text that are cut into windows at a time.
BLOCK = 512


def first_bytes(chars: np.ndarray) -> np.ndarray:
    """The first byte of each character's UTF-8."""
    return np.select([chars < 0x80, chars < 0x800, chars < 0x10000], [chars, 0xC0 | chars >> 6, 0xE0 | chars >> 12], 0xF0 | chars >> 18).astype(np.int32)


def prefixes_of(windows: list[str], freq: np.ndarray, longest: int, least: int, open_end: bool) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(pieces, n, low, high) of the prefixes of two characters and more of sorted windows, whose last character only follows.

    Prefixes that end inside the list are whole and are left out if they're rarer than ``least`` or, with
    open_end, always followed by the same byte; those at its ends may go on in other lists.
    """
    sizes = np.fromiter(map(len, windows), np.int64, len(windows))
    chars = np.array(windows, f"U{longest + 1}").view(np.uint32).reshape(len(windows), longest + 1)
    differs = np.zeros(len(windows), bool)  # from the window before, in the first k characters
    whole = np.ones(len(windows), bool)  # no NUL, which no piece may hold
    for k in range(1, longest + 1):
        differs[1:] |= chars[1:, k - 1] != chars[:-1, k - 1]
        whole &= chars[:, k - 1] != 0
        if k < 2:
            continue
        at = np.flatnonzero(sizes > k)
        if not len(at):
            break
        group = np.cumsum(differs)[at]
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        end = np.concatenate((begin[1:], [len(at)])) - 1
        n = np.add.reduceat(freq[at], begin)
        low, high = first_bytes(chars[at[begin], k]), first_bytes(chars[at[end], k])
        keep = (n >= least) & (low != high) if open_end else n >= least
        keep[[0, -1]] = True
        keep &= whole[at[begin]]
        if keep.any():
            yield np.ascontiguousarray(chars[at[begin[keep]], :k]).view(f"U{k}").ravel().tolist(), n[keep], low[keep], high[keep]


def prefix_counts(rows: DataFrame, longest: int, least: int = 2, open_end: bool = False) -> DataFrame:
    """``piece, n``: substrings of 2 to ``longest`` characters, without NUL, that occur ``least`` times in rows ``text, freq, end``.

    end: the character after the text. With open_end only those that different bytes follow. Each
    character sends one window, which holds all substrings that begin there: sorted windows have
    equal substrings side by side, so what is rare is dropped before substrings are exchanged.
    """
    t = F.col("text")
    text = rows.filter(F.char_length(t) > 1).select(F.concat(t, "end").alias("text"), (F.char_length(t) - 1).alias("most"), F.col("freq").cast("bigint").alias("freq"))
    # Long texts go by blocks: a place in a string is found by counting from its beginning.
    blocks = text.select("text", "most", "freq", F.explode(F.sequence(F.lit(0), F.col("most") - 1, F.lit(BLOCK))).alias("at"))
    blocks = blocks.select(t.substr(F.col("at") + 1, F.lit(BLOCK + longest)).alias("block"), F.least(F.lit(BLOCK), F.col("most") - F.col("at")).alias("most"), "freq")
    begins = blocks.select("block", "freq", F.explode(F.sequence(F.lit(1), "most")).alias("i"))
    windows = begins.select(F.col("block").substr(F.col("i"), F.lit(longest + 1)).alias("window"), "freq").repartitionByRange("window").sortWithinPartitions("window")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for pieces, *cols in prefixes_of(b.column(0).to_pylist(), b.column(1).to_numpy(), longest, least, open_end):
                    yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), *map(pa.array, cols)], names=["piece", "n", "low", "high"])

    counted = windows.mapInArrow(count, "piece string, n bigint, low int, high int").groupBy("piece").agg(F.sum("n").cast("bigint").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return counted.filter((F.col("n") >= least) & ((F.col("low") != F.col("high")) | F.lit(not open_end))).select("piece", "n")


def repeated_substrings(rows: DataFrame, spec: TrainerSpec, order: str | None = None) -> DataFrame:
    """``piece, n``: valid substrings of at least two characters that occur twice and are followed by different bytes.

    rows: ``text, freq``. With ``order``, the column that orders the rows, what ends a row is
    followed by the next row's first byte, and such ends count once more, as the reference
    counts them; that takes one ordered pass and is meant for corpora of moderate size.
    """
    if order:
        return ordered_substrings(rows, spec, order)
    if spec.split_by_whitespace and not spec.whitespace_as_suffix and not spec.allow_whitespace_only:
        # Equal words count together; a blank or the row's end follows. Beyond the next blank no piece is valid.
        words = F.split("text", f"(?={SPACE})", -1)
        rows = rows.select(F.posexplode(words).alias("__at", "text"), (F.size(words) - 1).alias("__last"), "freq")
        rows = rows.select("text", F.when(F.col("__at") == F.col("__last"), "\0").otherwise(SPACE).alias("end"), "freq")
    else:
        rows = rows.select("text", F.lit("\0").alias("end"), "freq")
    rows = rows.groupBy("text", "end").agg(F.sum("freq").cast("bigint").alias("freq"))
    return prefix_counts(rows, spec.max_piece_length, 2, True).filter(valid_piece_column("piece", spec))


def ordered_substrings(rows: DataFrame, spec: TrainerSpec, order: str) -> DataFrame:
    """``repeated_substrings`` of rows in an order."""
    t = F.col("text")
    n = F.char_length(t)
    following = F.lead(F.substring(F.hex(F.encode(t, "UTF-8")), 1, 2)).over(Window.orderBy(order))
    own = F.substring(F.hex(F.encode(t, "UTF-8")), 1, 2)
    rows = rows.withColumn("__after", F.array_distinct(F.array_compact(F.array(F.when(F.col("freq") > 1, own), F.coalesce(following, F.lit("--"))))))
    begins = rows.filter(n > 0).select("text", "freq", "__after", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    most = F.least(F.lit(spec.max_piece_length), n - F.col("i") + 1)
    if spec.split_by_whitespace and not spec.whitespace_as_suffix and not spec.allow_whitespace_only:
        # Beyond the next blank no piece is valid.
        blank = F.call_function("locate", F.lit(SPACE), t, F.col("i") + 1)
        most = F.when(blank > 0, F.least(most, blank - F.col("i"))).otherwise(most)
    subs = begins.select("text", "freq", "__after", "i", F.explode(F.sequence(F.lit(1), most)).alias("k"))
    following = F.substring(F.hex(F.encode(F.concat(t, F.lit("\0")).substr(F.col("i") + F.col("k"), F.lit(1)), "UTF-8")), 1, 2)
    inner = subs.select(t.substr(F.col("i"), F.col("k")).alias("piece"), F.lit(False).alias("ended"), F.array(following).alias("nexts"), "freq")
    ended = subs.filter(F.col("i") + F.col("k") - 1 == n)
    inner = inner.unionByName(ended.select(t.substr(F.col("i"), F.col("k")).alias("piece"), F.lit(True).alias("ended"), F.col("__after").alias("nexts"), "freq"))
    # Numbers aggregate by hash; two different ones have different ends.
    code = lambda x: F.when(x == "--", -1).otherwise(F.conv(x, 16, 10).cast("int"))
    inner = inner.withColumn("nexts", F.transform("nexts", code))
    grouped = inner.groupBy("piece", "ended").agg(F.sum("freq").alias("n"), F.min(F.array_min("nexts")).alias("low"), F.max(F.array_max("nexts")).alias("high"))
    twice = grouped.filter((F.col("n") >= 2) & (F.col("low") != F.col("high")) & (F.octet_length("piece") > 1))
    summed = twice.groupBy("piece").agg(F.sum("n").cast("bigint").alias("n")).filter(F.char_length("piece") >= 2)
    return summed.filter(valid_piece_column("piece", spec))


def seed_pieces(rows: DataFrame, spec: TrainerSpec, order: str | None = None) -> list[tuple[str, float]]:
    """All characters by count, then the best substrings by count times length; scores are log shares."""
    chars = char_histogram(rows, "text", "freq").filter(~F.col("char").isin(RARE, "\x1f")).collect()
    letters = sorted(((r.char, r.freq) for r in chars), key=lambda x: (-x[1], x[0]))
    value = (F.col("n") * F.pow(F.char_length("piece"), F.lit(spec.seed_length_power))).cast("bigint")
    parts = rows.select(F.explode(F.split("text", "\x1f", -1)).alias("text"), "freq", *([order] if order else [])).filter("text <> ''")
    top = repeated_substrings(parts, spec, order).withColumn("value", value)
    top = top.orderBy(F.col("value").desc(), F.octet_length("piece").desc(), "piece").limit(spec.seed_size).select("piece", "value").toArrow()
    found = [*letters, *sorted(zip(top["piece"].to_pylist(), top["value"].to_pylist()), key=lambda x: (-x[1], -len(x[0].encode()), x[0]))]
    total = math.log(sum(n for _, n in found))
    return [(p, math.log(n) - total) for p, n in found]


def _kernel(pieces: list[tuple[str, float]]) -> UnigramKernel:
    return UnigramKernel([*((p, s, NORMAL) for p, s in pieces), ("<unk>", 0.0, UNKNOWN)])


_newest: dict = {}


def newest(name: str, make: Callable[[], Trainable]) -> Trainable:
    """What ``make`` builds, once in a worker and step; those of earlier steps are let go."""
    if name not in _newest:
        _newest.clear()
        _newest[name] = make()
    return _newest[name]


def over_pieces(rows: DataFrame, pieces: list[tuple[str, float]], count: Callable[[Trainable, Iterator[pa.RecordBatch]], tuple[list[int], list[float]]]) -> tuple[np.ndarray, float]:
    """n by id, summed over what each partition of rows ``text, freq`` counts, and that of id -1. The pieces go once to each executor."""
    name, sent = uuid4().hex, rows.sparkSession.sparkContext.broadcast(([p for p, _ in pieces], [s for _, s in pieces]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = count(newest(name, lambda: Trainable(*sent.value)), batches)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n, pa.float64())], names=["id", "n"])

    try:
        got = rows.select("text", "freq").mapInArrow(each, "id int, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # one row a piece
    finally:
        sent.destroy()
    counts = np.zeros(len(pieces) + 2)
    counts[got["id"].to_numpy() + 1] = got["n"].to_numpy()
    return counts[1:-1], float(counts[0])


def expected_counts(rows: DataFrame, pieces: list[tuple[str, float]], known_only: bool = False) -> tuple[np.ndarray, float]:
    """Expected counts of pieces over all segmentations of rows ``text, freq``, and the summed log-likelihood.

    Each partition sends one row a piece at most; partial sums are added in the order of ids.
    """

    def expect(kernel: Trainable, batches: Iterator[pa.RecordBatch]) -> tuple[list[int], list[float]]:
        counts: dict[int, float] = {}
        total = 0.0
        for b in batches:
            for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    total += kernel.expected(t, w, counts, known_only)
        return [-1, *counts], [total, *counts.values()]

    return over_pieces(rows, pieces, expect)


def viterbi_counts(rows: DataFrame, pieces: list[tuple[str, float]]) -> np.ndarray:
    def best(kernel: Trainable, batches: Iterator[pa.RecordBatch]) -> tuple[list[int], list[float]]:
        counts: Counter = Counter()
        for b in batches:
            for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i in kernel.best(t) if t else ():
                    counts[i] += w
        return list(counts), list(counts.values())

    return over_pieces(rows, pieces, best)[0]


def maximised(pieces: list[tuple[str, float]], counts: np.ndarray) -> list[tuple[str, float]]:
    """Pieces expected at least half a time, with the scores of a sparse Bayesian estimate."""
    kept = [(p, float(n)) for (p, _), n in zip(pieces, counts) if n >= 0.5]
    total = digamma(sum(n for _, n in kept))
    return [(p, digamma(n) - total) for p, n in kept]


def alternatives_of(pieces: list[tuple[str, float]]) -> tuple[list[bool], list[list[int]]]:
    """For each piece whether its own best path is itself, and the pieces that would replace it."""
    kernel = _kernel(pieces)
    keep, others = [], []
    for p, _ in pieces:
        found = []
        for path, _ in kernel.paths(p):
            found.append([e.id for e in path])
            if len(found) == 2:
                break
        keep.append(len(found) < 2 or len(found[0]) == 1)
        others.append(found[1] if len(found) == 2 and len(found[0]) == 1 else [])
    return keep, others


def pruned(pieces: list[tuple[str, float]], freq: np.ndarray, target: int, factor: float, protected: frozenset[str] = frozenset()) -> list[tuple[str, float]]:
    """Pieces without those whose loss costs the likelihood least."""
    keep, others = alternatives_of(pieces)
    total = freq.sum()
    out, candidates = [], []
    for i, (p, s) in enumerate(pieces):
        if p in protected and freq[i] == 0:
            out.append((p, s))
        elif freq[i] == 0 or not (keep[i] or p in protected):
            continue
        elif not others[i]:
            out.append((p, s))
        else:
            own = math.log(freq[i]) - math.log(total)
            after = math.log(total + freq[i] * (len(others[i]) - 1))
            instead = sum(math.log((freq[n] if n < len(freq) else 0.0) + freq[i]) - after for n in others[i])
            candidates.append((-(freq[i] / total) * (own - instead), i))
    size = max(target, int(factor * len(pieces)))
    for _, i in sorted(candidates):
        if len(out) >= size:
            break
        out.append(pieces[i])
    return out


def sparse_rounds(rows: DataFrame, pieces: list[tuple[str, float]], target: int, epochs: int = 50) -> list[tuple[str, float]]:
    """EM with an L1 threshold that anneals to the target size, then one unpenalised refit."""
    for epoch in range(epochs):
        counts, _ = expected_counts(rows, pieces)
        goal = max(target, int(len(pieces) - (len(pieces) - target) * min(1.0, (epoch + 1) / 10)))
        order = np.sort(counts)
        penalty = float(order[len(order) - goal - 1]) if goal < len(order) else 0.0
        kept = [(p, max(1e-4, n - penalty)) for (p, _), n in zip(pieces, counts) if len(p) == 1 or n > penalty]
        total = math.log(sum(n for _, n in kept))
        done = len(kept) <= target or len(kept) == len(pieces) and penalty == 0
        pieces = [(p, math.log(n) - total) for p, n in kept]
        if done:
            break
    counts, _ = expected_counts(rows, pieces)
    total = math.log(counts.sum())
    return [(p, math.log(max(n, 1e-4)) - total) for (p, _), n in zip(pieces, counts)]


def train_unigram(df: DataFrame, spec: TrainerSpec, normalizer: NormalizerSpec = NormalizerSpec(), order: str | None = None, seeds: list[tuple[str, float]] | None = None, protected: tuple[str, ...] = ()) -> Model:
    """A unigram vocabulary by expectation maximisation and pruning.

    Where no piece crosses words, the loop runs over distinct weighted words, which changes no
    expectation. order: see ``repeated_substrings``; df then holds that column. Covered characters
    and protected pieces that don't fit the vocabulary are an error, under a soft limit they stay.
    """
    base = training_rows(df, spec, normalizer)
    rows, chars = covered(base, spec)
    room, must = spec.vocab_size - len(special_layout(spec)), len({*protected, *(c for c, _ in chars)})
    need(not spec.hard_vocab_limit or must <= room, f"vocabulary of {spec.vocab_size} is too small for {must} characters and protected pieces")
    if order:  # rows of a table in files keep their order up to here
        rows = rows.withColumn(order, F.monotonically_increasing_id())
    rows = cut(rows)
    pieces = seeds or seed_pieces(rows, spec, order)
    if spec.split_by_whitespace:
        loop = words_of(rows, spec).select(F.col("word").alias("text"), "freq")
    else:
        loop = rows.select(F.explode(F.split("text", "\x1f", -1)).alias("text"), "freq").filter("text <> ''").groupBy("text").agg(F.sum("freq").cast("bigint").alias("freq"))
    loop = cut(loop)
    target = int(spec.vocab_size * 1.1)
    if spec.sparse_pruning:
        pieces = sparse_rounds(loop, pieces, target)
    else:
        while True:
            for _ in range(spec.num_sub_iterations):
                counts, _ = expected_counts(loop, pieces)
                pieces = maximised(pieces, counts)
            before = len(pieces)
            pieces = pruned(pieces, viterbi_counts(loop, pieces), target, spec.shrinking_factor, frozenset(protected))
            if len(pieces) <= target or len(pieces) == before:
                break
    gone = set(_kernel(pieces).unreachable())
    pieces = [x for i, x in enumerate(pieces) if i not in gone]
    return assemble(spec, finished(pieces, chars, room, protected), normalizer, must)


def finished(pieces: list[tuple[str, float]], chars: list[tuple[str, int]], room: int, protected: tuple[str, ...] = ()) -> list[tuple[str, float]]:
    """Protected pieces and required characters first, then the best of the rest; all by score.

    A required character that was pruned gets a little more than the smallest score, the rarer
    ones more than the frequent ones.
    """
    scores = dict(pieces)
    least = min(scores.values(), default=0.0)
    out = {p: scores.get(p, least) for p in sorted(protected)}
    extra = 0.0
    for c, _ in chars:
        if c in scores:
            out[c] = scores[c]
        else:
            out[c] = least + extra
            extra += 0.0001
    for p, s in sorted(pieces, key=lambda x: (-x[1], x[0])):
        if len(out) >= room:
            break
        out.setdefault(p, s)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def train(df: DataFrame, spec: TrainerSpec, normalizer: NormalizerSpec = NormalizerSpec()) -> Model:
    """A model of the type that the options name."""
    spec = spec.validated()
    if spec.model_type == "bpe":
        return train_pairs(df, spec, normalizer)[0]
    return {"char": train_chars, "word": train_words, "unigram": train_unigram}[spec.model_type](df, spec, normalizer)
