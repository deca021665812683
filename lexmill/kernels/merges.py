"""Merging neighbours: by vocabulary score, by ranked rules, and inside fenced blocks of ids."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass, field

from ..spec import NORMAL, UNUSED, USER_DEFINED, SpecError, need
from .text import PrefixMatcher

WORD = (1 << 64) - 1


def merge(symbols: Sequence[Hashable], rule: Callable, drop: Callable | None = None, stats: dict | None = None) -> list[tuple[int, int, Hashable]]:
    """Neighbours merged until no rule applies: (begin, end, symbol), positions in the symbols given.

    rule(left, right) is (priority, result) or None; the smallest priority goes first, then the
    leftmost. drop(priority, position, left version, right version) may skip an occurrence; it
    comes up again only if a neighbouring merge changes it.
    """
    n = len(symbols)
    value, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    version, end = [0] * n, list(range(1, n + 1))
    heap: list = []
    count = stats if stats is not None else {}

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if i < 0 or j >= n:
            return
        r = rule(value[i], value[j])
        if r is not None:
            count["pushed"] = count.get("pushed", 0) + 1
            heapq.heappush(heap, (r[0], i, j, version[i], version[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        priority, i, j, vi, vj = heapq.heappop(heap)
        count["popped"] = count.get("popped", 0) + 1
        if version[i] != vi or version[j] != vj or after[i] != j:
            count["stale"] = count.get("stale", 0) + 1
            continue
        if drop is not None and drop(priority, i, vi, vj):
            count["dropped"] = count.get("dropped", 0) + 1
            continue
        value[i] = rule(value[i], value[j])[1]
        after[i], end[i] = after[j], end[j]
        if after[i] < n:
            before[after[i]] = i
        version[i] += 1
        version[j] = -1
        count["merges"] = count.get("merges", 0) + 1
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append((i, end[i], value[i]))
        i = after[i]
    return out


#: Words of so many characters are merged in a list, longer ones with a heap; the result is the same.
SHORT, NO_PAIR = 200, float("-inf")


class PairKernel:
    """Segmenting by the scores of a merge vocabulary: the pair whose union scores best is merged first.

    USER_DEFINED pieces are taken whole, UNUSED results are split again the way they were made.
    """

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, UNUSED, USER_DEFINED)}
        self.scores = {p: s for p, s, t in pieces if t in (NORMAL, UNUSED)}
        self.unused = {p for p, _, t in pieces if t == UNUSED}
        users = [p for p, _, t in pieces if t == USER_DEFINED]
        self.users = frozenset(users)
        self.matcher = PrefixMatcher(users)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "UNKNOWN"), -1)

    def short(self, text: str) -> list[tuple[int, int, int]]:
        """The same for a word: the best pair is looked for among all, the leftmost first."""
        parts, get = list(text), self.scores.get
        pairs = [get(a + b, NO_PAIR) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > NO_PAIR:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NO_PAIR)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NO_PAIR)
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p), self.ids.get(p, self.unknown)))
            at += len(p)
        return out

    def best(self, text: str, alpha: float = 0.0, rng=None) -> list[tuple[int, int, int]]:
        """(begin, end, id) of the pieces. alpha: the share of merges that is skipped at random."""
        if not text:
            return []
        if alpha <= 0 and len(text) <= SHORT and not self.users and not self.unused:
            return self.short(text)
        parts = self.matcher.split(text) if self.users else [(c, False) for c in text]
        made: dict[str, tuple[str, str]] = {}
        scores, unused = self.scores, self.unused

        def rule(a: tuple[str, bool], b: tuple[str, bool]):
            if a[1] or b[1]:
                return None
            s = scores.get(a[0] + b[0])
            if s is None:
                return None
            if a[0] + b[0] in unused:
                made[a[0] + b[0]] = (a[0], b[0])
            return -s, (a[0] + b[0], False)

        drop = None if alpha <= 0 else (lambda *_: alpha >= 1 or rng.random() < alpha)
        out, at = [], 0

        def emit(piece: str, depth: int = 0) -> None:
            nonlocal at
            if piece in unused and piece in made and depth < 100:
                for half in made[piece]:
                    emit(half, depth + 1)
                return
            out.append((at, at + len(piece), self.ids.get(piece, self.unknown)))
            at += len(piece)

        for _, _, (piece, _) in merge(parts, rule, drop):
            emit(piece)
        return out


# --- id overlays ------------------------------------------------------------------------------


def mix(x: int) -> int:
    """A step of the public 64-bit split-mix generator."""
    x = (x + 0x9E3779B97F4A7C15) & WORD
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD
    return x ^ (x >> 31)


@dataclass
class Overlay:
    """A program of ranked merge rules over ids, which apply between fences only.

    rules: (rank, left, right, child, expansion). Ids below ``base`` are the base vocabulary's;
    a rule's child is an id of its own from ``base`` to below ``size``.
    """

    base: int
    size: int
    opening: int
    closing: int
    rules: list[tuple[int, int, int, int, tuple[int, ...]]]
    protected: frozenset[int] = frozenset()
    fixed: int = 0
    longest_input: int = 1 << 20
    pairs: dict = field(default_factory=dict)
    expansions: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        need(0 < self.base <= self.size, "the base vocabulary must lie in the model's")
        need(self.opening != self.closing and all(0 <= x < self.base for x in (self.opening, self.closing)), "fences must be two base ids")
        blocked = {self.opening, self.closing, *self.protected}
        need(len({r[0] for r in self.rules}) == len(self.rules), "a rank stands twice")
        for rank, left, right, child, expansion in sorted(self.rules):
            need((left, right) not in self.pairs, f"pair {left}, {right} stands twice")
            need(self.base <= child < self.size and child not in self.expansions, f"child {child} is no new overlay id")
            for x in (left, right):
                need(x not in blocked, f"rule {rank} uses the protected id {x}")
                need(0 <= x < self.base or x in self.expansions, f"rule {rank} uses {x}, which no rule before it makes")
            whole = self.spelled(left) + self.spelled(right)
            need(tuple(expansion) == whole, f"the expansion of {child} isn't that of its halves")
            need(whole not in self.expansions.values(), f"the expansion of {child} stands twice")
            self.pairs[left, right] = (rank, child)
            self.expansions[child] = whole
        need(0 <= self.fixed <= len(self.rules), "more fixed rules than rules")

    def spelled(self, x: int) -> tuple[int, ...]:
        return self.expansions.get(x, (x,))

    def blocks(self, ids: Sequence[int], unclosed: bool):
        """(fenced, ids, position of the closing fence) of the parts of a sequence, with all errors of the fences."""
        need(len(ids) <= self.longest_input, "too many ids")
        inside, part = False, []
        for at, x in enumerate(ids):
            need(0 <= x < self.size, f"id {x} is out of range")
            if x == self.opening:
                need(not inside, "a fence opens inside a block")
                yield False, [*part, x], at
                inside, part = True, []
            elif x == self.closing:
                need(inside, "a fence closes that wasn't open")
                yield True, part, at
                inside, part = False, [x]
            else:
                need(x < self.base or (inside and x in self.expansions), f"extension id {x} stands outside a block or is unknown")
                part.append(x)
        need(not inside or unclosed, "a block isn't closed")
        yield inside, part, len(ids)

    def encode(self, ids: Sequence[int], dropout: float = 0.0, seed: int = 0, unclosed: bool = False, stats: dict | None = None) -> list[int]:
        need(0 <= dropout <= 1, "dropout must be from 0 to 1")
        out: list[int] = []
        for fenced, part, at in self.blocks(ids, unclosed):
            out += self._merged(part, dropout, mix((seed ^ at) & WORD), stats) if fenced else part
        return out

    def _merged(self, part: list[int], dropout: float, seed: int, stats: dict | None) -> list[int]:
        def rule(a: int, b: int):
            return None if a in self.protected or b in self.protected else self.pairs.get((a, b))

        def drop(rank: int, position: int, left: int, right: int) -> bool:
            if rank < self.fixed or dropout <= 0:
                return False
            if dropout >= 1:
                return True
            h = mix(seed ^ rank)
            h = mix(h ^ position)
            h = mix(h ^ (left << 32) ^ right)
            return (h >> 11) / 2**53 < dropout

        return [x for _, _, x in merge(part, rule, drop, stats)]

    def expand(self, ids: Sequence[int], unclosed: bool = False) -> list[int]:
        out: list[int] = []
        for fenced, part, _ in self.blocks(ids, unclosed):
            out += [y for x in part for y in self.spelled(x)] if fenced else part
        need(len(out) <= self.longest_input, "too many ids after expansion")
        return out


# --- ranked programs over text -----------------------------------------------------------------


def atoms(text: str, known: dict[str, int], longest: int) -> list[str]:
    """The one split of text into atoms with the fewest unknown characters; two such splits are an error."""
    n = len(text)
    cost, ways, back = [0] + [n + 1] * n, [1] + [0] * n, [0] * (n + 1)
    for i in range(n):
        single = False
        for k in range(1, min(longest, n - i) + 1):
            if text[i : i + k] in known:
                single = single or k == 1
                step = 0
            elif k == 1:
                step = 1
            else:
                continue
            c = cost[i] + step
            if c < cost[i + k]:
                cost[i + k], ways[i + k], back[i + k] = c, min(ways[i], 2), i
            elif c == cost[i + k]:
                ways[i + k] = min(ways[i + k] + ways[i], 2)
    if ways[n] > 1:
        raise SpecError(f"more than one split of {text[:40]!r} into atoms")
    out, at = [], n
    while at:
        out.append(text[back[at] : at])
        at = back[at]
    return out[::-1]


class RankedProgram:
    """Segmenting by ranked merges of (left, right) strings over atoms: lowest rank first, then leftmost.

    pieces: (external id, piece, type, atomic). merges: (rank, left, right, child).
    """

    def __init__(self, pieces: list[tuple[int, str, str, bool]], merges: list[tuple[int, str, str, str]]):
        self.ids = {p: i for i, p, _, _ in pieces}
        self.types = {p: t for _, p, t, _ in pieces}
        need(len(self.ids) == len(pieces), "a piece stands twice")
        need(sorted(i for i, *_ in pieces) == list(range(len(pieces))), "ids must be dense from 0")
        need(sum(t == "UNKNOWN" for _, _, t, _ in pieces) == 1, "there must be one unknown piece")
        self.unknown = next(i for i, _, t, _ in pieces if t == "UNKNOWN")
        self.atoms = {p: i for i, p, t, a in pieces if a}
        need(all(self.atoms) if self.atoms else True, "an empty atom")
        self.longest = max(map(len, self.atoms), default=1)
        self.users = [p for _, p, t, _ in pieces if t == USER_DEFINED]
        self.matcher = PrefixMatcher(self.users)
        self.rules: dict[tuple[str, str], tuple[int, str]] = {}
        for rank, left, right, child in sorted(merges):
            need((left, right) not in self.rules, f"the pair {left!r}, {right!r} stands twice")
            need(not {left, right} & set(self.users), "a merge uses a user-defined piece")
            need(left + right == child, "a child that isn't its halves")
            self.rules[left, right] = (rank, child)

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, end, id), positions in characters of text."""
        parts: list[tuple[str, bool]] = []
        run: list[str] = []
        for piece, user in [*(self.matcher.split(text) if self.users else [(c, False) for c in text]), ("", True)]:
            if not user:
                run.append(piece)
                continue
            if run:
                parts += [(a, a in self.atoms) for a in atoms("".join(run), self.atoms, self.longest)]
                run = []
            if piece:
                parts.append((piece, False))

        def rule(a: tuple[str, bool], b: tuple[str, bool]):
            r = self.rules.get((a[0], b[0])) if a[1] and b[1] else None
            return r and (r[0], (r[1], True))

        out, at = [], 0
        for _, _, (piece, _) in merge(parts, rule):
            out.append((at, at + len(piece), self.ids.get(piece, self.unknown)))
            at += len(piece)
        return out
