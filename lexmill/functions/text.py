"""Text functions on columns: built-in expressions where they say the same, else Arrow functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..kernels import text as K
from ..spec import BOUNDARY, RARE, SPACE, NormalizerSpec, TrainerSpec

_made: dict = {}


def kept(key, make):
    """What ``make`` builds, once in a worker."""
    if key not in _made:
        if len(_made) > 16:
            _made.clear()
        _made[key] = make()
    return _made[key]


def blanks(c: Column, spec: NormalizerSpec) -> Column:
    """The blank handling of a normal form as built-in expressions, each argument of which stands once."""
    if spec.remove_extra_whitespaces:
        c = F.regexp_replace(F.trim(c), " {2,}", " ")
    if spec.add_dummy_prefix:
        # A text that isn't empty gets a blank at its beginning or end.
        c = F.regexp_replace(c, "(?s)(?<=.)\\z" if spec.suffix else "(?s)\\A(?=.)", " ")
    return F.replace(c, F.lit(" "), F.lit(SPACE)) if spec.escape_whitespaces else c


def filled(c: Column, spec: NormalizerSpec, symbols: tuple[str, ...] = ()) -> Column | None:
    """Whether the normal form isn't empty, as a cheap condition on the text; None if only the normal form tells."""
    if spec.rules is not None or spec.name != "identity" or symbols:
        return None
    return F.trim(c) != "" if spec.remove_extra_whitespaces else c != ""


def nmt_column(c: Column) -> Column:
    """The nmt rules as one translation."""
    blank, gone = "".join(map(chr, K.NMT_BLANKS)), "".join(map(chr, K.NMT_DROPPED))
    return F.translate(c, blank + gone, " " * len(blank))


def normalize_column(col: str | Column, spec: NormalizerSpec = NormalizerSpec(), symbols: tuple[str, ...] = ()) -> Column:
    """The normal form; null stays null. Rules other than ``identity`` and ``nmt`` go through Python."""
    c = F.col(col) if isinstance(col, str) else col
    if spec.rules is None and spec.name in ("identity", "nmt") and not symbols:
        return blanks(nmt_column(c) if spec.name == "nmt" else c, spec)

    @arrow_udf("string")
    def normalize(text: pa.Array) -> pa.Array:
        own = kept(("normalizer", spec, symbols), lambda: K.Normalizer(spec, symbols))
        return pa.array([None if t is None else own(t) for t in text.to_pylist()], pa.string())

    return normalize(c)


def aligned_column(col: str | Column, spec: NormalizerSpec = NormalizerSpec(), symbols: tuple[str, ...] = ()) -> Column:
    """STRUCT<text, origin ARRAY<INT>>: the normal form and where each of its bytes, and its end, comes from."""

    @arrow_udf("struct<text string, origin array<int>>")
    def align(text: pa.Array) -> pa.Array:
        own = kept(("normalizer", spec, symbols), lambda: K.Normalizer(spec, symbols))
        rows = [None if t is None else dict(zip(("text", "origin"), own.aligned(t))) for t in text.to_pylist()]
        return pa.array(rows, pa.struct([("text", pa.string()), ("origin", pa.list_(pa.int32()))]))

    return align(F.col(col) if isinstance(col, str) else col)


def decode_column(col: str | Column) -> Column:
    """BINARY to STRING; each byte outside a valid character becomes U+FFFD."""

    @arrow_udf("string")
    def lossy(raw: pa.Array) -> pa.Array:
        return pa.array([None if b is None else K.decode(b) for b in raw.to_pylist()], pa.string())

    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(lossy(c))


def char_offsets_column(text: str | Column, offsets: str | Column) -> Column:
    """Byte offsets of a text as character offsets."""

    @arrow_udf("array<int>")
    def convert(t: pa.Array, o: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else K.to_char_offsets(a, b) for a, b in zip(t.to_pylist(), o.to_pylist())], pa.list_(pa.int32()))

    return convert(text, offsets)


def words_column(col: str | Column, suffix: bool = False, whitespace_only: bool = False, interval: bool = False, barline: bool = False) -> Column:
    """The words of an escaped text as ARRAY<STRING>."""
    c = F.col(col) if isinstance(col, str) else col
    if interval or barline:
        pattern = f"(?={SPACE}[{'/1-9' if interval else ''}{'|' if barline else ''}])"
    elif suffix:
        pattern = f"(?<={SPACE})(?!{SPACE})" if whitespace_only else f"(?<={SPACE})"
    else:
        pattern = f"(?<!{SPACE})(?={SPACE})" if whitespace_only else f"(?={SPACE})"
    return F.filter(F.split(c, pattern, -1), lambda w: w != "")


def valid_piece_column(col: str | Column, spec: TrainerSpec = TrainerSpec()) -> Column:
    """Whether a string may be a learnt piece. Length, reserved and blank rules are built in; scripts go through Python, for strings that pass so far.

    As a filter over aggregated strings it stays above the aggregate: Python sees each string once.
    """
    c = F.col(col) if isinstance(col, str) else col
    shape = (c != "") & (F.char_length(c) <= spec.max_piece_length) & ~c.rlike(f"[{RARE}\\x00{BOUNDARY} ]")

    @arrow_udf("boolean")
    def valid(piece: pa.Array) -> pa.Array:
        return pa.array([None if p is None else K.valid_piece(p, spec) for p in piece.to_pylist()], pa.bool_())

    once = valid.asNondeterministic()  # else Catalyst moves it below the aggregate, where rows are many and wide
    return F.coalesce(shape, F.lit(False)) & F.coalesce(once(F.when(shape, c)), F.lit(False))


def script_column(col: str | Column) -> Column:
    """The script of the first character."""

    @arrow_udf("string")
    def name(c: pa.Array) -> pa.Array:
        return pa.array([None if not x else K.script(x[0]) for x in c.to_pylist()], pa.string())

    return name(F.col(col) if isinstance(col, str) else col)


def replace_all_column(col: str | Column, strings: list[str], by: str) -> Column:
    """Every leftmost-longest occurrence of a string replaced."""
    c = F.col(col) if isinstance(col, str) else col
    found = sorted(set(filter(None, strings)), key=lambda s: (-len(s), s))
    if not found:
        return c
    pattern = "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in found)
    return F.regexp_replace(c, F.lit(pattern), F.lit(by.replace("\\", "\\\\").replace("$", "\\$")))


def sha256_column(col: str | Column) -> Column:
    return F.sha2((F.col(col) if isinstance(col, str) else col).cast("binary"), 256)
