"""Problem 7: passages of evaluation items inside training documents.

One Aho-Corasick automaton holds stretches of the normalised items, chosen for each item so that
every passage that counts holds one unchanged (see ``anchors_of``). Each document is normalised the
same way and scanned once; stretches that hit near the same diagonal of a document and an item are
extended to exact runs and chained over changed words, and the chain is measured against the item.
Offsets lead back to the original text.

Items go to the workers as broadcast blocks of a bounded size, of which the driver holds one at a
time. Documents are read and normalised once: where there are several blocks, a worker holds some
documents and takes them through the automaton of each block in turn.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import LOOKALIKES

LEAKS = "doc_id bigint, item_id bigint, begin_char int, end_char int, matched int, item_letters int, changed int"
#: Bytes of item text in one automaton, bytes of documents that are taken through all of them together, and automata kept by a worker.
BLOCK_BYTES, HELD_BYTES, KEPT = 8 << 20, 32 << 20, 3
#: The longest stretches and their stride: in words, and in letters where no blanks stand between words.
SPACED, SOLID = (4, 1), (9, 2)
#: Letters a word has in scripts without blanks, for counting changed words.
SOLID_WORD = 3
#: Longest gap between runs of one passage, in letters (more in items with long words).
GAP = 64
#: The shortest run beyond a gap: letters anywhere, letters of whole words.
RESUME, RESUME_WORDS = 8, 4
#: Letters between two runs within which no further run is looked for.
NEAR = 16
CHANGED = 6

#: Look-alike letters without case; where a capital and its small form look like different letters, the capital counts.
SWAPS = str.maketrans({k.casefold(): v.casefold() for k, v in sorted(LOOKALIKES.items(), key=lambda x: x[0].isupper()) if len(k.casefold()) == 1})
LOOK = re.compile("[" + "".join(map(chr, sorted(SWAPS))) + "]")
#: Tags with their attributes, targets of links, character references.
MARKUP = re.compile(r"</?[A-Za-z][\w:-]*+(?:\s[^<>]*+|/)?>|(?<=\])\([^()\s]*+\)|&(?:[A-Za-z]{2,8}|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});")
NO_LETTER = re.compile(r"[\W_]+")
ASCII_OTHER = bytes(n for n in range(128) if not chr(n).isalnum())
BLANKLESS = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")


def folded(text: str) -> str:
    """text without differences of case, width, composition and look-alike letters."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    return text.translate(SWAPS) if LOOK.search(text) else text


def stream(text: str) -> str:
    """The letters and digits of text, folded, without markup."""
    if "<" in text or "&" in text or "](" in text:
        text = MARKUP.sub("", text)
    # Most of what goes is ASCII and goes at once; the pattern looks for the rest.
    text = folded(text).encode("utf-8", "surrogatepass").translate(None, ASCII_OTHER).decode("utf-8", "surrogatepass")
    return text if text.isascii() else NO_LETTER.sub("", text)


def origins(text: str) -> list[int]:
    """For each letter of stream(text) the offset in text it comes from."""
    out: list[int] = []
    at = 0
    for m in [*MARKUP.finditer(text), None]:
        # A character and the marks after it fold together.
        for piece in re.finditer(r"[^\W_][^\w\s]*|.", text[at : m.start() if m else len(text)], re.S):
            out += [at + piece.start()] * len(NO_LETTER.sub("", folded(piece[0])))
        at = m.end() if m else at
    return out


@dataclass
class Item:
    key: int
    text: str
    starts: list[int]
    solid: bool
    gap: int = GAP
    known_probes: dict[bool, dict[int, int]] = field(default_factory=dict)

    def words(self, begin: int, end: int) -> int:
        """Words that begin in a part of the item."""
        if self.solid:
            return max(1, round((end - begin) / SOLID_WORD))
        return bisect_left(self.starts, end) - bisect_left(self.starts, begin)

    def probes(self, turned: bool) -> dict[int, int]:
        if turned not in self.known_probes:
            self.known_probes[turned] = self._probes(turned)
        return self.known_probes[turned]

    def _probes(self, turned: bool) -> dict[int, int]:
        """At the begin of each word, how many letters of whole words are looked for there; turned: from the other end."""
        size = len(self.text)
        bounds = [*range(0, size, SOLID_WORD), size] if self.solid else [*self.starts, size]
        if turned:
            bounds = [size - b for b in reversed(bounds)]
        out, j = {}, 0
        for i, b in enumerate(bounds[:-1]):
            j = max(j, i + 1)
            while j + 1 < len(bounds) and bounds[j] - b < RESUME_WORDS:
                j += 1
            out[b] = min(RESUME, bounds[j] - b) if bounds[j] - b >= RESUME_WORDS else RESUME
        return out

    def split(self, begin: int, end: int) -> list[str]:
        """The words of a part, cut to it."""
        if self.solid:
            return [self.text[i : min(i + SOLID_WORD, end)] for i in range(begin, end, SOLID_WORD)]
        inner = [s for s in self.starts if begin < s < end]
        return [self.text[a:b] for a, b in zip([begin, *inner], [*inner, end])]


def item_of(key: int, text: str) -> Item:
    starts, n, whole = [], 0, []
    for word in MARKUP.sub("", text).split():
        w = NO_LETTER.sub("", folded(word))
        if w:
            starts.append(n)
            whole.append(w)
            n += len(w)
    joined = "".join(whole)
    longest = max((b - a for a, b in zip(starts, [*starts[1:], n])), default=0)
    solid = len(BLANKLESS.findall(joined)) > len(joined) / 3
    return Item(key, joined, starts, solid, GAP if solid else max(GAP, 2 * longest + RESUME))


def surest(cases: list[tuple[int, int]], most: tuple[int, int]) -> tuple[int, int, int]:
    """Length and stride of stretches, and how many of them every passage that counts holds unchanged.

    cases: the units that stay unchanged in a passage, and the changes that part them, so one run
    more. A run of R units holds (R - length - stride + 2) / stride whole stretches or more.
    """
    for length in range(most[0], 0, -1):
        stride = min(most[1], length)
        least = min(-(-(kept - (cut + 1) * (length + stride - 2)) // stride) for kept, cut in cases)
        if least > 0:
            return length, stride, least
    return 1, 1, 1


def anchors_of(item: Item) -> tuple[list[tuple[int, int]], int]:
    """Begin and end of stretches, and how many of them every passage that counts holds unchanged.

    That is fewest for the shortest passage with half of the letters, or for the next one that
    may have a changed word more. The last word of a passage may be cut and then isn't in a stretch.
    """
    size = len(item.text)
    need = (size + 1) // 2
    if not need:
        return [], 1
    letters = lambda length, stride: [(at, at + length) for at in range(0, size - length + 1, stride)]
    if item.solid:
        c = item.words(0, need) // CHANGED
        more = SOLID_WORD * CHANGED * (c + 1) - SOLID_WORD // 2  # letters that are rounded to so many words
        length, stride, least = surest([(n - SOLID_WORD * k, k) for n, k in ((need, c), (more, c + 1))], SOLID)
        return letters(length, stride), least
    fewest = min(item.words(b, b + need) for b in (0, *(x + 1 for x in item.starts)) if b + need <= size)
    more = CHANGED * (fewest // CHANGED + 1)
    cases = [(w - 1 - w // CHANGED, w // CHANGED) for w in (fewest, more)]
    if fewest > 1:
        length, _, least = surest(cases, SPACED)
    else:  # part of one word may be half of the item
        length, _, least = surest(cases[1:], SPACED)
    bounds = [*item.starts, size]
    out = list(zip(bounds, bounds[length:]))
    if fewest > 1:
        return out, least
    return out + letters(*surest([(need, 0)], SOLID)[:2]), 1


class Scanner:
    """The automaton over items, and the matching of one document."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [item_of(k, t) for k, t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.least: list[int] = []
        for n, item in enumerate(self.items):
            anchors, least = anchors_of(item)
            self.least.append(least)
            for begin, end in anchors:
                places[item.text[begin:end]].append((n, begin))
        self.automaton = ahocorasick.Automaton()
        # The places of stretch k are first[k] to first[k + 1] of owner and offset.
        flat, first = [], [0]
        for k, (stretch, found) in enumerate(places.items()):
            self.automaton.add_word(stretch, (k, len(stretch)))
            flat += found
            first.append(len(flat))
        self.owner, self.offset = (np.array(x, np.int64) for x in (zip(*flat) if flat else ([], [])))
        self.first = np.array(first)
        self.fewest, self.gaps = np.array(self.least, np.int64), np.array([x.gap for x in self.items], np.int64)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """(item key, begin, end, matched letters, letters of the item, changed words); begin and end in stream(text)."""
        return [] if self.empty else self.matched(stream(text))

    def matched(self, doc: str) -> list[tuple[int, int, int, int, int, int]]:
        found = [(k, end + 1 - size) for end, (k, size) in self.automaton.iter(doc)]
        if not found:
            return []
        best: dict[int, tuple[int, int, int, int]] = {}
        for n, group in self.groups(np.array(found)):
            got = passage(doc, self.items[n], group)
            if got and (n not in best or got[2] > best[n][2]):
                best[n] = got
        return [(x.key, b[0], b[1], b[2], len(x.text), b[3]) for n, b in sorted(best.items()) if 2 * b[2] >= len((x := self.items[n]).text)]

    def groups(self, found: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Item number and anchors (position, place in the item) of near diagonals that may belong to one passage.

        found: stretch and position of each hit. Groups with fewer different places than a passage
        that counts has are left out.
        """
        k, pos = found[:, 0], found[:, 1]
        many = self.first[k + 1] - self.first[k]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[k], many)
        owner, at, pos = self.owner[place], self.offset[place], np.repeat(pos, many)
        often = np.bincount(owner, minlength=len(self.fewest)) >= self.fewest
        keep = often[owner]
        owner, at, pos = owner[keep], at[keep], pos[keep]
        if not len(owner):
            return
        order = np.lexsort((pos, pos - at, owner))
        owner, at, pos = owner[order], at[order], pos[order]
        diagonal = pos - at
        new = np.flatnonzero((owner[1:] != owner[:-1]) | (diagonal[1:] - diagonal[:-1] > self.gaps[owner[1:]])) + 1
        bounds = np.concatenate(([0], new, [len(owner)]))
        for b in np.flatnonzero(bounds[1:] - bounds[:-1] >= self.fewest[owner[bounds[:-1]]]).tolist():
            part = slice(bounds[b], bounds[b + 1])
            n = int(owner[part.start])
            places = at[part].tolist()
            if len(set(places)) >= self.least[n]:
                yield n, list(zip(pos[part].tolist(), places))


def ahead(a: str, i: int, b: str, j: int) -> int:
    """How many letters of a from i and of b from j are equal."""
    n, step = 0, 32
    most = min(len(a) - i, len(b) - j)
    while n < most:
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n = min(most, n + step)
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return n


def behind(a: str, i: int, b: str, j: int) -> int:
    n, most = 0, min(i, j)
    while n < most and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def runs(doc: str, item: Item, anchors: list[tuple[int, int]]) -> list[list[int]]:
    """Exact runs [position in doc, in item, length] through the anchors, and further runs beyond changed words at their ends."""
    text = item.text
    out: list[list[int]] = []
    seen: dict[int, int] = {}
    for pos, at in sorted(anchors):
        if seen.get(pos - at, -1) >= pos:
            continue
        back = behind(doc, pos, text, at)
        n = ahead(doc, pos, text, at)
        out.append([pos - back, at - back, back + n])
        seen[pos - at] = pos + n
    known = {(r[0], r[1]) for r in out}
    turned = doc[::-1], text[::-1], item.probes(True), item.gap
    onward = doc, text, item.probes(False), item.gap
    # Nothing is looked for where the next run is so near that the words between are compared one by one.
    begins, stops = [(r[0], r[1]) for r in out], [(r[0] + r[2], r[1] + r[2]) for r in out]
    near = lambda d, i: 0 <= d <= NEAR and 0 <= i <= NEAR
    for pos, at, n in tuple(out):
        end = pos + n, at + n
        while not any(near(d - end[0], i - end[1]) for d, i in begins) and (more := resumed(*onward, *end)) is not None:
            # What follows may begin before the place where it was found.
            b = behind(doc, more[0], text, more[1])
            more = [more[0] - b, more[1] - b, more[2] + b]
            if (more[0], more[1]) in known:
                break
            known.add((more[0], more[1]))
            out.append(more)
            end = more[0] + more[2], more[1] + more[2]
        begin = len(doc) - pos, len(text) - at
        if any(near(pos - d, at - i) for d, i in stops):
            continue
        while (more := resumed(*turned, *begin)) is not None:
            begin = more[0] + more[2], more[1] + more[2]
            d, i = len(doc) - begin[0], len(text) - begin[1]
            if (d, i) in known:
                break
            known.add((d, i))
            out.append([d, i, more[2] + ahead(doc, d + more[2], text, i + more[2])])
    return sorted(out, key=lambda r: (r[1], r[0]))


def resumed(doc: str, item: str, probes: dict[int, int], gap: int, pos: int, at: int) -> list[int] | None:
    """The next run after a changed word."""
    window = doc[pos : pos + gap // 2 + RESUME]
    for skip in range(0, min(gap // 2, len(item) - at)):
        size = probes.get(at + skip, RESUME)
        if at + skip + size > len(item):
            continue
        here = window.find(item[at + skip : at + skip + size])
        if here >= 0 and (skip or here):
            n = ahead(doc, pos + here, item, at + skip)
            return [pos + here, at + skip, n]
    return None


def changes(doc: str, item: Item, one: list[int], two: list[int]) -> int | None:
    """Changed words between two runs, or None if they don't belong together."""
    d0, d1, i0, i1 = one[0] + one[2], two[0], one[1] + one[2], two[1]
    if d1 < d0 or i1 < i0:  # an overlap by equal letters at the edges of a changed word
        over = max(d0 - d1, i0 - i1)
        d0, i0 = d0 - over, i0 - over
    if d1 - d0 > item.gap or i1 - i0 > item.gap:
        return None
    left, n = doc[d0:d1], 0
    for w in item.split(i0, i1) if i1 > i0 else []:
        here = left.find(w) if len(w) > 1 else -1
        if here < 0:
            n += 1
        else:
            left = left[here + len(w) :]
    return max(n, 1)


def passage(doc: str, item: Item, anchors: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
    """(begin, end, letters of the item, changed words) of the largest passage with few enough changes."""
    rs = runs(doc, item, anchors)
    links: list[list[tuple[int, int]]] = [[] for _ in rs]
    for i, one in enumerate(rs):
        for j in range(i + 1, len(rs)):
            two = rs[j]
            if two[1] - one[1] - one[2] > item.gap:
                break
            # Both begin and end later, in the document and in the item.
            if two[0] > one[0] and two[1] > one[1] and two[0] + two[2] > one[0] + one[2] and two[1] + two[2] > one[1] + one[2]:
                n = changes(doc, item, one, two)
                if n is not None:
                    links[i].append((j, n))
    best = None
    for i in range(len(rs)):
        least = {i: 0}  # the fewest changed words up to each run; links lead to later ones only
        for j in range(i, len(rs)):
            if j not in least:
                continue
            begin, end = rs[i][1], rs[j][1] + rs[j][2]
            if least[j] * CHANGED <= item.words(begin, end) and (best is None or end - begin > best[2]):
                best = rs[i][0], rs[j][0] + rs[j][2], end - begin, least[j]
            for k, n in links[j]:
                least[k] = min(least.get(k, 1 << 30), least[j] + n)
    return best


_scanners: dict[tuple[str, int], Scanner] = {}


def scanner_of(name: str, n: int, block: Broadcast) -> Scanner:
    """The automaton of a block, kept for the next batches and tasks of this worker."""
    if (name, n) not in _scanners:
        for old in [k for k in _scanners if k[0] != name] + list(_scanners)[: max(0, len(_scanners) - KEPT + 1)]:
            _scanners.pop(old, None)
        path = getattr(block, "_path", None)
        _scanners[name, n] = Scanner(block.load_from_path(path) if path else block.value)  # the items aren't kept beside the automaton
    return _scanners[name, n]


def held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of at least ``most`` bytes."""
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _scan(blocks: list[Broadcast], name: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
        names = [f.split()[0] for f in LEAKS.split(", ")]
        for group in held(batches, HELD_BYTES if len(blocks) > 1 else 1):
            docs = [(key, text, stream(text)) for b in group for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if text]
            # From the block used last to the first, then back: its automaton is still there.
            known = [n for n in range(len(blocks)) if (name, n) in _scanners]
            for n in known + [n for n in range(len(blocks)) if n not in known]:
                scanner = scanner_of(name, n, blocks[n])
                rows = []
                for doc, text, letters in docs:
                    found = [] if scanner.empty else scanner.matched(letters)
                    if found:
                        place = origins(text)
                        for key, begin, end, matched, whole, changed in found:
                            exact = len(place) >= end
                            rows.append((doc, key, place[begin] if exact else None, place[end - 1] + 1 if exact else None, matched, whole, changed))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return scan


def item_blocks(items: DataFrame) -> list[Broadcast]:
    """The items as broadcasts of about BLOCK_BYTES of text. The driver reads partition by partition and lets go of each block."""
    spark = items.sparkSession
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // BLOCK_BYTES)
    if parts > 1:
        texts = texts.repartition(4 * parts, "item_id", F.xxhash64("text"))
    out, block, size = [], [], 0
    for key, text in texts.toLocalIterator():
        block.append((key, text))
        size += len(text.encode("utf-8", "surrogatepass"))
        if size >= BLOCK_BYTES:
            out.append(spark.sparkContext.broadcast(sorted(block)))
            block, size = [], 0
    if block:
        out.append(spark.sparkContext.broadcast(sorted(block)))
    return out


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, begin_char, end_char, matched, item_letters, changed`` for each item that a document holds.

    docs: ``doc_id BIGINT, text STRING``; items: ``item_id BIGINT, text STRING``; other columns
    are ignored. An item leaks if one continuous passage with at least half of its letters and
    digits stands in the document, with at most one changed word in six. A pair comes once, with
    its longest passage. Null and empty texts and items without letters match nothing; equal
    items leak each; repeated documents are scanned each.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan(item_blocks(items), uuid4().hex), LEAKS)
