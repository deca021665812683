"""Ranked merge programs over arrays of ids, inside fenced blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..kernels.merges import Overlay
from .segment import _lists

STATS = ("pushed", "popped", "stale", "dropped", "merges")


def overlay_of(rules: DataFrame, base: int, size: int, opening: int, closing: int, protected: tuple[int, ...] = (), fixed: int = 0, most: int = 1_000_000) -> Overlay:
    """A checked program of a table ``rank, left_id, right_id, child_id, base_expansion``; more than ``most`` rules are an error."""
    rows = rules.select("rank", "left_id", "right_id", "child_id", "base_expansion").take(most + 1)
    if len(rows) > most:
        raise ValueError("too many rules")
    return Overlay(base, size, opening, closing, [(r[0], r[1], r[2], r[3], tuple(r[4])) for r in rows], frozenset(protected), fixed)


def overlay_encode(ids: Column | str, overlay: Overlay, dropout: float = 0.0, seed: Column | int = 0, unclosed: bool = False) -> Column:
    """ARRAY<INT>; null for null. Dropout is settled by the row's seed alone."""

    @arrow_udf("array<int>")
    def encode(batch: pa.Array, seeds: pa.Array) -> pa.Array:
        return _lists([None if x is None else overlay.encode(x, dropout, s or 0, unclosed) for x, s in zip(batch.to_pylist(), seeds.to_pylist())])

    s = F.lit(seed) if isinstance(seed, int) else seed
    return encode(F.col(ids) if isinstance(ids, str) else ids, s.cast("bigint"))


def overlay_stats(ids: Column | str, overlay: Overlay, dropout: float = 0.0, seed: int = 0, unclosed: bool = False) -> Column:
    """STRUCT of what encoding a row did: candidates pushed, popped, stale and dropped, and merges."""
    kind = pa.struct([(s, pa.int64()) for s in STATS])

    @arrow_udf("struct<" + ", ".join(f"{s} bigint" for s in STATS) + ">")
    def stats(batch: pa.Array) -> pa.Array:
        out = []
        for x in batch.to_pylist():
            own: dict = {}
            if x is not None:
                overlay.encode(x, dropout, seed, unclosed, own)
            out.append(None if x is None else {s: own.get(s, 0) for s in STATS})
        return pa.array(out, kind)

    return stats(F.col(ids) if isinstance(ids, str) else ids)


def overlay_expand(ids: Column | str, overlay: Overlay, unclosed: bool = False) -> Column:
    @arrow_udf("array<int>")
    def expand(batch: pa.Array) -> pa.Array:
        return _lists([None if x is None else overlay.expand(x, unclosed) for x in batch.to_pylist()])

    return expand(F.col(ids) if isinstance(ids, str) else ids)


def expanded(ids: Column | str, overlay: Overlay) -> Column:
    """The expansion alone, without the checks of fences, as built-in expressions."""
    c = F.col(ids) if isinstance(ids, str) else ids
    if not overlay.expansions:
        return c
    table = F.create_map(*[x for child, base in sorted(overlay.expansions.items()) for x in (F.lit(child), F.array(*map(F.lit, base)))])
    return F.flatten(F.transform(c, lambda x: F.coalesce(F.try_element_at(table, x), F.array(x))))
