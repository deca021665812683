"""Encoding and decoding columns with a model.

The model travels in the task's closure (a vocabulary is bounded by its training options) and is
built once in a worker. Where no piece crosses words, a batch is split into words and
dictionary-encoded in Arrow, each distinct word is worked out once in a worker and looked up from
then on, and the ids are gathered by their numbers; no shuffle is needed for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import kept, normalize_column
from ..kernels.model import Model
from ..spec import SPACE, USER_DEFINED, NormalizerSpec

SPAN = pa.struct([("piece", pa.string()), ("id", pa.int32()), ("surface", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])
SPAN_DDL = "array<struct<piece string, id int, surface string, begin int, end int>>"
#: Words a worker remembers.
KNOWN_WORDS = 1 << 20


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lists(rows: list[list[int] | None]) -> pa.Array:
    """Lists of ids as one Arrow array, by its buffers."""
    if any(r is None for r in rows):
        return pa.array(rows, pa.list_(pa.int32()))
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))


def words_of(model: Model, batch: pa.Array) -> pa.Array | None:
    """The words of each text, without their space signs, null for null and empty texts; None if a text may begin without the sign."""
    spec = model.normalizer
    plain = spec.rules is None and spec.name == "identity" and not model.normalize.symbols
    if plain and spec.add_dummy_prefix and spec.escape_whitespaces:
        text = batch
        if spec.remove_extra_whitespaces:
            text = pc.utf8_trim(text, " ")
            if pc.any(pc.match_substring(text, "  ")).as_py():
                text = pc.replace_substring_regex(text, " +", " ")
        text, sign = pc.replace_substring(text, SPACE, " "), " "
        return pc.split_pattern(filled(text), sign)
    text = filled(pa.array([None if t is None else model.normalize(t) for t in batch.to_pylist()], pa.string()))
    if pc.all(pc.starts_with(text, SPACE)).as_py() is False:
        return None
    return pc.split_pattern(pc.utf8_slice_codeunits(text, 1), SPACE)


def filled(text: pa.Array) -> pa.Array:
    """text with null for what is empty."""
    return pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)


class BatchEncoder:
    """Ids of batches of texts, for models whose pieces don't cross words and stand behind their space sign."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}

    def ids_of(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            m, full = self.model, SPACE + word
            ids = tuple(m.finished_ids(full, m.segment(full)))
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def __call__(self, batch: pa.Array) -> pa.Array:
        words = words_of(self.model, batch)
        if words is None:
            return _lists([None if t is None else self.model.encode(t) for t in batch.to_pylist()])
        coded = words.flatten().dictionary_encode()
        own = list(map(self.ids_of, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        starts = np.cumsum(sizes) - sizes
        flat = np.fromiter(chain.from_iterable(own), np.int32, int(sizes.sum()))
        code = coded.indices.to_numpy()
        size = sizes[code]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(starts[code] - ends[:-1], size) + np.arange(ends[-1])]
        rows = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))))
        bounds = ends[rows]
        if not self.model.trainer.byte_fallback:  # unknown pieces side by side are one
            unknown = ids == self.model.unk
            again = np.zeros(len(ids), bool)
            again[1:] = unknown[1:] & unknown[:-1]
            again[bounds[:-1][bounds[:-1] < len(ids)]] = False
            ids, bounds = ids[~again], bounds - np.concatenate(([0], np.cumsum(again)))[bounds]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pc.is_null(batch) if batch.null_count else None)


def encoder(model: Model) -> Callable[[pa.Array], pa.Array]:
    if model.by_words and not model.trainer.whitespace_as_suffix:
        return kept(("batches", model.key), lambda: BatchEncoder(model))
    if model.by_words:
        known = kept(("words", model.key), dict)
        return lambda batch: _lists([None if t is None else model.encode_words(t, known, KNOWN_WORDS) for t in batch.to_pylist()])
    return lambda batch: _lists([None if t is None else model.encode(t) for t in batch.to_pylist()])


def encode_ids(text: str | Column, model: Model, options: str = "") -> Column:
    """ARRAY<INT>; null for null, empty for empty text. options as ``bos:eos:reverse``, applied in order."""
    model.options(options)

    @arrow_udf("array<int>")
    def ids(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        return encoder(own)(batch)

    return with_options(ids(_col(text)), options, model)


def encode_long(df: DataFrame, model: Model, key: str, text: str = "text", chunk: int = 1 << 20) -> DataFrame:
    """``key, ids``: the same as ``encode_ids`` for a table with very long texts, whose parts are encoded in tasks of their own.

    A normal form of more than ``chunk`` characters is cut before a space sign, where no piece
    crosses; a model whose pieces do cross words takes whole texts. The key must be unique and not
    null; a null text gives null, an empty one no ids.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if not model.by_words or model.trainer.whitespace_as_suffix or not model.normalizer.escape_whitespaces:
        return rows.select(F.col("key").alias(key), encode_ids("text", model).alias("ids"))
    kind = df.select(key).dtypes[0][1]
    symbols = tuple(p for p, _, t in model.pieces if t == USER_DEFINED)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                out, at = [], 0
                while t is not None and len(t) - at > chunk:
                    end = t.rfind(SPACE, at + 1, at + chunk + 1)
                    end = t.find(SPACE, at + chunk) if end < 0 else end
                    if end < 0:
                        break
                    out.append(t[at:end])
                    at = end
                out.append(None if t is None else t[at:])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(out), b.schema.field(0).type), pa.array(range(len(out)), pa.int32()), pa.array(out, pa.string())], names=["key", "part", "text"])

    cut_up = rows.select("key", normalize_column("text", model.normalizer, symbols).alias("text")).mapInArrow(parts, f"key {kind}, part int, text string")
    ready = Model(model.pieces, model.trainer, NormalizerSpec("identity", add_dummy_prefix=False, remove_extra_whitespaces=False), model.denormalizer)
    coded = cut_up.repartition("key", "part").select("key", "part", encode_ids("text", ready).alias("ids"))
    whole = coded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.select(F.col("key").alias(key), (F.col("ids") if model.trainer.byte_fallback else unknown_runs_merged("ids", model.unk)).alias("ids"))


def encode_pieces(text: str | Column, model: Model, options: str = "") -> Column:
    """ARRAY<STRING>: unknown stretches stand as they are, or with the option ``unk`` as the unknown piece."""
    model.options(options)

    @arrow_udf("array<string>")
    def pieces(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        run = own.piece_options(options)
        return pa.array([None if t is None else run([(p, i) for p, i, *_ in own.pieces_of(t)]) for t in batch.to_pylist()], pa.list_(pa.string()))

    return pieces(_col(text))


def encode_spans(text: str | Column, model: Model) -> Column:
    """ARRAY<STRUCT<piece, id, surface, begin, end>>; offsets are UTF-8 bytes of the original text."""

    @arrow_udf(SPAN_DDL)
    def spans(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        return pa.array([None if t is None else [vars(s) for s in own.spans(t)] for t in batch.to_pylist()], pa.list_(SPAN))

    return spans(_col(text))


def encode_nbest(text: str | Column, model: Model, size: int) -> Column:
    """ARRAY<ARRAY<INT>>, the best first; for unigram models."""
    if model.trainer.model_type != "unigram":
        raise ValueError("n-best is for unigram models")

    @arrow_udf("array<array<int>>")
    def nbest(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        return pa.array([None if t is None else own.nbest(t, size) for t in batch.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return nbest(_col(text))


def best_score(text: str | Column, model: Model) -> Column:
    """DOUBLE: the score of the best path of a unigram model; 0 for empty text, null for null."""

    @arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        return pa.array([None if t is None else own.kernel.best(own.normalize(t))[1] for t in batch.to_pylist()], pa.float64())

    return score(_col(text))


def sample_ids(text: str | Column, model: Model, alpha: float, seed: int = 0, size: int = -1) -> Column:
    """ARRAY<INT> drawn at random; the seed and the text settle each draw, whatever the partitions."""
    if model.trainer.model_type not in ("unigram", "bpe"):
        raise ValueError("sampling is for unigram and bpe models")

    @arrow_udf("array<int>")
    def sampled(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        return _lists([None if t is None else own.sample(t, alpha, seed, size) for t in batch.to_pylist()])

    return sampled(_col(text))


def decode_ids(ids: str | Column, model: Model) -> Column:
    """STRING; an id out of range is an error."""

    @arrow_udf("string")
    def decoded(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        return pa.array([None if x is None else own.decode(x) for x in batch.to_pylist()], pa.string())

    return decoded(_col(ids))


def decode_pieces(pieces: str | Column, model: Model) -> Column:
    @arrow_udf("string")
    def decoded(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        return pa.array([None if x is None else own.decode_pieces(x) for x in batch.to_pylist()], pa.string())

    return decoded(_col(pieces))


def decode_spans(ids: str | Column, model: Model) -> Column:
    @arrow_udf(SPAN_DDL)
    def spans(batch: pa.Array) -> pa.Array:
        own = kept(("model", model.key), lambda: model)
        return pa.array([None if x is None else [vars(s) for s in own.decode_spans(x)] for x in batch.to_pylist()], pa.list_(SPAN))

    return spans(_col(ids))


def token_counts(df: DataFrame, model: Model, text: str = "text", freq: str | None = None) -> DataFrame:
    """``id, n``: how often each piece is produced. Counted inside each partition first, so little is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("model", model.key), lambda: model)
        run, total = encoder(own), np.zeros(len(own.pieces), np.int64)
        for b in batches:
            if b.num_rows:
                ids = run(b.column(0))
                weight = pc.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False)
                size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                np.add.at(total, ids.flatten().to_numpy(zero_copy_only=False), np.repeat(weight, size))
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    weight = F.col(freq).cast("bigint") if freq else F.lit(1).cast("bigint")
    return df.select(F.col(text).alias("text"), weight.alias("freq")).mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").cast("bigint").alias("n"))


def used_vocabulary(df: DataFrame, model: Model, vocab: DataFrame, text: str = "text", freq: str | None = None) -> DataFrame:
    """``piece, n`` of the pieces produced, unknown and control ones left out."""
    counts = token_counts(df, model, text, freq)
    return counts.join(vocab.filter("type not in ('UNKNOWN', 'CONTROL')").withColumnRenamed("piece_id", "id"), "id").select("piece", "n")


def char_pieces(text: str | Column, symbols: list[str] = []) -> Column:
    """ARRAY<STRING>: user-defined symbols, the longest first, else single characters. Built in."""
    found = sorted(set(symbols), key=lambda s: (-len(s), s))
    pattern = "(?s)(" + "".join("\\Q" + s + "\\E|" for s in found) + ".)"
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1))


def unknown_runs_merged(ids: str | Column, unk: int = 0) -> Column:
    """ids with each run of unknown ones as one. Built in."""
    return F.aggregate(
        _col(ids), F.array().cast("array<int>"),
        lambda acc, x: F.when((x == unk) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) == unk), acc).otherwise(F.concat(acc, F.array(x))),
    )


def with_options(ids: str | Column, options: str, model: Model) -> Column:
    """Options on a column of ids, with built-in expressions."""
    model.options(options)
    c = _col(ids)
    for name in filter(None, options.split(":")):
        if name == "reverse":
            c = F.reverse(c)
        elif name in ("bos", "eos"):
            i = F.array(F.lit(model.special(getattr(model.trainer, f"{name}_piece"))))
            c = F.concat(i, c) if name == "bos" else F.concat(c, i)
    return c


def spelled(pieces: str | Column, keep_prefix: bool = False) -> Column:
    """Text of pieces without byte pieces, with built-in expressions."""
    c = F.replace(F.array_join(_col(pieces), ""), F.lit("▁"), F.lit(" "))
    return c if keep_prefix else F.ltrim(c)
