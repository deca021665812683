"""Problem 6: cutting oversized texts at natural boundaries, with an overlap.

Lexical cohesion: at each sentence or line end the word counts of the block before and the block
after are compared; where their similarity is lower than on both sides the text changes its
topic. Of the ends inside a size window the one in the deepest valley is cut; without any, the
last white space or punctuation; without that, for texts with token spans, the last token edge;
else the last character that fits, which is a forced cut.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "item_kind string, item_id bigint, piece_no int, begin_char int, end_char int, begin_byte int, end_byte int, cut string, item_cut string, text string"
LIMIT, OVERLAP = 4192, 200
#: Words compared on each side of a boundary.
BLOCK = 60
SCRIPT = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
#: Characters of scripts without blanks stand for themselves; elsewhere a word is a word.
WORD = re.compile(rf"[{SCRIPT}]|[^\W{SCRIPT}]+")
#: Where a sentence or a line ends.
END = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？।॥]+[”’」』）\"]*|\n)\s*")


@cache
def breaks() -> np.ndarray:
    """For each code point whether it is white space or punctuation (category P)."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        out[c] = x.isspace() or unicodedata.category(x)[0] == "P"
    return out


def depths(text: str, ends: np.ndarray) -> np.ndarray:
    """For each end (a character offset) how deep the valley of similarity is there."""
    if len(ends) < 2:
        return np.zeros(len(ends))
    words, at = [], []
    for m in WORD.finditer(text):
        words.append(m[0].casefold())
        at.append(m.start())
    if not words:
        return np.zeros(len(ends))
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    edge = np.searchsorted(np.array(at), ends)
    lows, highs = np.maximum(edge - BLOCK, 0), np.minimum(edge + BLOCK, len(ids))
    sim = np.zeros(len(ends))
    for a in range(0, len(ends), 256):  # in slices, for the memory of very long texts
        s = slice(a, a + 256)
        n = len(edge[s])
        base, top = int(lows[s].min()), int(highs[s].max())
        own, small = np.unique(ids[base:top], return_inverse=True)

        def counts(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            size = end - begin
            row = np.repeat(np.arange(n), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            return np.bincount(row * len(own) + small[place - base], minlength=n * len(own)).reshape(n, len(own)).astype(np.float32)

        left, right = counts(lows[s], edge[s]), counts(edge[s], highs[s])
        norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
        sim[s] = np.divide((left * right).sum(1), norm, out=np.zeros(n), where=norm > 0)
    # A valley's depth: how far the similarity climbs to the nearest peak on each side.
    up_left, up_right = sim.copy(), sim.copy()
    for i in range(1, len(sim)):
        if up_left[i - 1] > up_left[i]:
            up_left[i] = up_left[i - 1] if sim[i - 1] >= sim[i] else sim[i]
    for i in range(len(sim) - 2, -1, -1):
        if up_right[i + 1] > up_right[i]:
            up_right[i] = up_right[i + 1] if sim[i + 1] >= sim[i] else sim[i]
    return (up_left - sim) + (up_right - sim)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, edges: np.ndarray | None = None) -> list[tuple[int, int, int, int, str]]:
    """(begin_char, end_char, begin_byte, end_byte, cut) of the pieces of a text.

    ``cut`` says how the piece ends: 'topic', 'space', 'token', 'forced' or 'end'. edges: byte
    offsets of tokens, for texts that have them. limit must be 8 at least, overlap below half of it.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate(([0], np.cumsum(sizes)))
    n, total = len(points), int(at[-1])
    if total <= limit:
        return [(0, n, 0, total, "end")]
    isbreak = breaks()[points]
    near = np.zeros(n + 1, bool)
    near[:-1] |= isbreak
    near[1:] |= isbreak
    near[0] = near[n] = True
    natural = np.flatnonzero(near)
    ends = np.fromiter((m.end() for m in END.finditer(text)), np.int64)
    deep = depths(text, ends)
    tokens = np.empty(0, np.int64)
    if edges is not None and len(edges):
        tokens = np.searchsorted(at, edges)
        tokens = tokens[(tokens > 0) & (tokens < n)]
        tokens = np.unique(tokens[np.isin(at[tokens], edges)])
    mark = lambda c: bool(unicodedata.combining(chr(points[c]))) if c < n else False
    out: list[tuple[int, int, int, int, str]] = []
    start, done = 0, 0
    while True:
        last = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        if last >= n:
            out.append((start, n, int(at[start]), total, "end"))
            return out
        floor = max(done + 1, int(np.searchsorted(at, at[start] + limit // 2)))
        lo, hi = np.searchsorted(ends, floor), np.searchsorted(ends, last, "right")
        i = int(np.searchsorted(natural, last, "right")) - 1
        if lo < hi:
            best = lo + int(np.flatnonzero(deep[lo:hi] == deep[lo:hi].max())[-1])
            cut, how = int(ends[best]), "topic"
        elif natural[i] > done:
            cut, how = int(natural[i]), "space"
        else:
            j = int(np.searchsorted(tokens, last, "right")) - 1
            if j >= 0 and tokens[j] > done:
                cut, how = int(tokens[j]), "token"
            else:
                cut, how = last, "forced"
                while mark(cut) and cut > done + 1 and last - cut < 32:
                    cut -= 1
        out.append((start, cut, int(at[start]), int(at[cut]), how))
        # The next piece begins where 200 bytes are shared, or as many as boundaries and limit allow.
        after = int(np.searchsorted(natural, cut, "right"))
        reach = int(at[natural[after]]) if after < len(natural) else total
        forced = reach - int(at[cut]) > limit
        least = max(int(at[cut]) - overlap, start + 1 and int(at[start]) + 1, 0 if forced else reach - limit)
        k = int(np.searchsorted(at[natural], least))
        begin = int(natural[k]) if k < len(natural) and natural[k] <= cut else cut
        if begin == cut and (forced or how in ("token", "forced")):
            j = int(np.searchsorted(at[tokens], least)) if len(tokens) else 0
            if j < len(tokens) and tokens[j] <= cut:
                begin = int(tokens[j])
            else:
                begin = min(cut, int(np.searchsorted(at, least)))
        start, done = begin, cut


def _cut(limit: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows, held = [], 0
            for kind, item, text, edges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                own = pieces(text, limit, overlap, np.array(edges.as_py(), np.int64) if edges.is_valid else None)
                whole = "forced" if any(p[4] in ("token", "forced") for p in own) else "natural"
                rows += [(kind, item, i, *p, whole, text[p[0] : p[1]]) for i, p in enumerate(own)]
                held += len(text)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return cut


def split_oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text over ``limit`` UTF-8 bytes.

    df: ``item_kind STRING, item_id BIGINT, text STRING, edges ARRAY<INT>`` (byte offsets of
    tokens, or null). Each piece has at most ``limit`` bytes, pieces cover the text in order, and
    each shares ``overlap`` bytes with the one before, or less where the boundaries don't allow
    more. ``item_cut`` is 'forced' for a text with a cut where no natural boundary was. Texts up
    to the limit, null and empty ones give no row; a repeated row is cut again; other columns are
    ignored.
    """
    rows = df.select("item_kind", F.col("item_id").cast("bigint").alias("item_id"), "text", F.col("edges").cast("array<int>").alias("edges"))
    return rows.filter(F.octet_length("text") > limit).mapInArrow(_cut(limit, overlap), PIECES)
