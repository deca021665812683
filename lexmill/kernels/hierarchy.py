"""Boundaries that merges respect: fenced strings, and gates of a hierarchy over the bytes of a text.

A gate is a parent with a level and its children's boundaries (cuts, byte offsets). Parents are
nested, and no boundary between children belongs to two of them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..spec import BOUNDARY, SpecError, need
from .merges import RankedProgram, atoms, merge


@dataclass(frozen=True)
class Gate:
    level: int
    cuts: tuple[int, ...]

    def has(self, cut: int) -> bool:
        k = bisect_left(self.cuts, cut)
        return k < len(self.cuts) and self.cuts[k] == cut

    def crossed(self, begin: int, end: int) -> bool:
        """Whether a boundary between children lies inside a span."""
        k = bisect_right(self.cuts, begin)
        return k < len(self.cuts) and self.cuts[k] < end and self.cuts[k] < self.cuts[-1]


def number(text: str, what: str) -> int:
    need(text.isascii() and text.isdigit(), f"invalid {what}: {text!r}")
    return int(text)


def parsed_gates(spec: str) -> tuple[Gate, ...]:
    """Gates of ``level:cut,cut,cut;level:...``; empty ones are skipped."""
    out = []
    for one in filter(None, spec.split(";")):
        level, colon, cuts = one.partition(":")
        need(colon, f"a gate is a level, a colon and cuts: {one!r}")
        out.append(Gate(number(level, "gate level"), tuple(number(c, "cut") for c in cuts.split(","))))
    return tuple(out)


def parsed_ranges(spec: str) -> tuple[tuple[int, int], ...]:
    """Byte ranges of ``begin-end,begin-end``."""
    out = []
    for one in spec.split(",") if spec else ():
        begin, dash, end = one.partition("-")
        need(dash, f"a range is a begin, a dash and an end: {one!r}")
        out.append((number(begin, "range"), number(end, "range")))
    return tuple(out)


def whole_character(raw: bytes, at: int) -> bool:
    return at in (0, len(raw)) or raw[at] & 0xC0 != 0x80


def checked_gates(gates: Iterable[Gate], text: str) -> tuple[Gate, ...]:
    """gates, if they fit the text: cuts increase and fall between characters, parents are nested, and those inside a parent keep to its children."""
    raw, gates = text.encode("utf-8", "surrogatepass"), tuple(gates)
    owned: set[int] = set()
    for g in gates:
        need(g.level > 0, "a gate's level must be 1 or more")
        need(len(g.cuts) >= 3, "a parent needs two children")
        need(all(a < b for a, b in zip(g.cuts, g.cuts[1:])), "cuts must increase")
        need(g.cuts[-1] <= len(raw), "a gate ends behind its text")
        need(all(whole_character(raw, c) for c in g.cuts), "a cut falls inside a UTF-8 character")
        need(owned.isdisjoint(g.cuts[1:-1]), "two parents claim the same boundary")
        owned.update(g.cuts[1:-1])
    above: list[Gate] = []
    for g in sorted(gates, key=lambda g: (g.cuts[0], -g.cuts[-1])):
        begin, end = g.cuts[0], g.cuts[-1]
        while above and above[-1].cuts[-1] <= begin:
            above.pop()
        for outer in above:
            need(end <= outer.cuts[-1], "parents overlap")
            need(not outer.crossed(begin, end) or (outer.has(begin) and outer.has(end)), "a nested parent crosses a boundary between an outer parent's children")
        above.append(g)
    return gates


@dataclass(frozen=True)
class Record:
    """What limits the support of merges in one text. ranges: None for no limit."""

    gates: tuple[Gate, ...] = ()
    ranges: tuple[tuple[int, int], ...] | None = None
    owners: tuple[tuple[int, int], ...] = field(default=(), compare=False)

    @staticmethod
    def of(text: str, gates: str, ranges: str | None) -> Record:
        raw, found = text.encode("utf-8", "surrogatepass"), None
        if ranges is not None:
            found, last = parsed_ranges(ranges), 0
            for begin, end in found:
                need(begin < end <= len(raw), f"invalid range {begin}-{end}")
                need(begin >= last, "ranges must be in order and apart")
                need(whole_character(raw, begin) and whole_character(raw, end), "a range falls inside a UTF-8 character")
                last = end
        own = checked_gates(parsed_gates(gates), text)
        return Record(own, found, tuple(sorted((c, n) for n, g in enumerate(own) for c in g.cuts[1:-1])))

    def supports(self, begin: int, end: int) -> bool:
        """Whether a span inside a range is, for each parent that it crosses, the whole parent or some whole children."""
        if self.ranges is not None:
            k = bisect_right(self.ranges, (begin, 1 << 62)) - 1
            if k < 0 or end > self.ranges[k][1]:
                return False
        for k in range(bisect_right(self.owners, (begin, 1 << 62)), len(self.owners)):
            cut, n = self.owners[k]
            if cut >= end:
                break
            g = self.gates[n]
            if not (begin <= g.cuts[0] and end >= g.cuts[-1]) and not (g.has(begin) and g.has(end)):
                return False
        return True


# --- fences -------------------------------------------------------------------------------------


def fenced(text: str, fences: Iterable[str]) -> list[tuple[int, int]]:
    """Stretches of the text that fenced strings cover: all occurrences, overlapping ones as one."""
    out: list[list[int]] = []
    by_first: dict[str, list[str]] = {}
    for f in sorted(set(fences), key=len, reverse=True):
        by_first.setdefault(f[0], []).append(f)
    for i, c in enumerate(text):
        size = next((len(f) for f in by_first[c] if text.startswith(f, i)), 0) if c in by_first else 0
        if size and out and i < out[-1][1]:
            out[-1][1] = max(out[-1][1], i + size)
        elif size:
            out.append([i, i + size])
    return [(a, b) for a, b in out]


# Fixed value: what a line of fences begins with in artifacts.
POLICY = "bpe_explicit_fences_v1:"


def fence_policy(fences: Iterable[str]) -> str:
    """The fences in one line: in order, with all but letters, digits, point, low line and hyphen as %XX."""
    safe = lambda b: chr(b) if b < 128 and (chr(b).isalnum() or chr(b) in "._-") else f"%{b:02X}"
    return POLICY + "[" + ",".join("".join(map(safe, f)) for f in sorted(f.encode() for f in set(fences))) + "]"


def segmented(text: str, program: RankedProgram, fences: Iterable[str] = (), cuts: Iterable[int] = ()) -> list[str]:
    """The atoms and user-defined pieces of a text, with a boundary sign where a fenced stretch begins or ends.

    A fence, or one of the cuts (byte offsets), inside one of them is an error.
    """
    parts: list[str] = []
    run = ""
    for piece, user in [*(program.matcher.split(text) if program.users else [(text, False)]), ("", True)]:
        if not user:
            run += piece
            continue
        if run:
            found = atoms(run, program.atoms, program.longest)
            need(all(a in program.atoms for a in found), f"{run[:40]!r} has no split into atoms")
            parts += found
            run = ""
        if piece:
            parts.append(piece)
    edges = {e for stretch in fenced(text, fences) for e in stretch}
    out, at, size, bounds = [], 0, 0, {0}
    for p in parts:
        if at in edges and out:
            out.append(BOUNDARY)
        inside = edges.intersection(range(at + 1, at + len(p)))
        need(not inside, f"a fence begins or ends inside {p!r}")
        out.append(p)
        at += len(p)
        size += len(p.encode("utf-8", "surrogatepass"))
        bounds.add(size)
    need(bounds.issuperset(cuts), "a cut falls inside an atom or a user-defined piece")
    return out


# --- merging under gates ------------------------------------------------------------------------


class ScopedProgram:
    """A ranked program with rules of their own for each completed level of a hierarchy.

    merges: (rank, left, right, child, level), level None for rules that apply anywhere. Those
    come first; then each rule of a level where it completes children of a parent of that level, and
    rules of level 0 where no parent is crossed. A parent that inherited tokens cross is left out.
    """

    def __init__(self, pieces: list[tuple[int, str, str, bool]], merges: list[tuple[int, str, str, str, int | None]]):
        self.plain = RankedProgram(pieces, [m[:4] for m in merges if m[4] is None])
        self.inherited = any(m[4] is None for m in merges)
        self.scoped: dict[tuple[str, str, int], tuple[int, str]] = {}
        for rank, left, right, child, level in sorted(merges, key=lambda m: m[0]):
            if level is not None:
                need(level >= 0 and left + right == child and (left, right, level) not in self.scoped, f"a rule for {left!r}, {right!r} at level {level} can't be")
                self.scoped[left, right, level] = rank, child

    def encode(self, text: str, gates: Iterable[Gate] | None) -> list[tuple[int, int, int]]:
        """(begin, end, id), positions in characters of a normal form."""
        if self.scoped and gates is None:
            raise SpecError("a hierarchical program needs the gates of each text")
        found = self.plain.encode(text)
        if not self.scoped:
            return found
        gates = checked_gates(gates, text)
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode("utf-8", "surrogatepass")))
        tokens = [(text[a:b], at[a], at[b], i) for a, b, i in found]
        enabled = []
        for g in gates:
            partly = any(g.crossed(a, b) and not (g.has(a) and g.has(b)) for _, a, b, _ in tokens)
            need(not partly or self.inherited, "a token crosses a boundary between children, and there is no inherited program to keep")
            enabled.append(not partly)
        owner = {c: n for n, g in enumerate(gates) for c in g.cuts[1:-1]}

        def level(a: tuple, b: tuple) -> int | None:
            n = owner.get(a[2])
            if n is None or not enabled[n]:
                return 0
            g = gates[n]
            return g.level if g.cuts[0] <= a[1] and b[2] <= g.cuts[-1] and g.has(a[1]) and g.has(b[2]) else None

        def rule(a: tuple, b: tuple):
            now = level(a, b)
            r = None if now is None or self.plain.unknown in (a[3], b[3]) else self.scoped.get((a[0], b[0], now))
            return r and (r[0], (r[1], a[1], b[2], self.plain.ids[r[1]]))

        out, n = [], 0
        for _, _, (piece, _, _, i) in merge(tokens, rule):
            out.append((n, n + len(piece), i))
            n += len(piece)
        return out
