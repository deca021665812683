"""A model: vocabulary, options and normal form; encoding and decoding of single strings."""

from __future__ import annotations

import hashlib
import json
import random
import re
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property
from itertools import chain

from ..spec import BYTE, CONTROL, NORMAL, SPACE, TYPES, UNKNOWN, USER_DEFINED, NormalizerSpec, SpecError, TrainerSpec, need
from .merges import PairKernel
from .text import Normalizer, PrefixMatcher, byte_offsets, split_words
from .unigram import UnigramKernel

BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
LONGEST_PIECE = 8000


def byte_piece(n: int) -> str:
    return f"<0x{n:02X}>"


@dataclass(frozen=True)
class Span:
    piece: str
    id: int
    surface: str
    begin: int
    end: int


@dataclass(frozen=True)
class Model:
    """pieces: (piece, score, type); an id is a position in the list."""

    pieces: tuple[tuple[str, float, str], ...]
    trainer: TrainerSpec = field(default_factory=TrainerSpec)
    normalizer: NormalizerSpec = field(default_factory=NormalizerSpec)
    denormalizer: NormalizerSpec | None = None

    # --- the vocabulary ---

    def checked(self) -> Model:
        """self, if its vocabulary may be loaded."""
        seen = set()
        for piece, _, kind in self.pieces:
            need(piece, "an empty piece")
            need(kind in TYPES, f"unknown type {kind!r}")
            need("\0" not in piece and len(piece.encode()) < LONGEST_PIECE, f"piece {piece[:20]!r} is too long or holds NUL")
            need(piece not in seen, f"piece {piece!r} stands twice")
            seen.add(piece)
        need(sum(t == UNKNOWN for _, _, t in self.pieces) == 1, "there must be exactly one unknown piece")
        held = {p for p, _, t in self.pieces if t == BYTE}
        need(not held or self.trainer.byte_fallback, "byte pieces without byte_fallback")
        need(not self.trainer.byte_fallback or held == {byte_piece(n) for n in range(256)}, "byte_fallback needs all 256 byte pieces")
        return self

    @cached_property
    def key(self) -> str:
        """Names what the model computes; workers keep what they built under it."""
        parts = [self.pieces, asdict(self.trainer), asdict(self.normalizer), self.denormalizer and asdict(self.denormalizer)]
        return hashlib.sha256(json.dumps(parts, ensure_ascii=True).encode()).hexdigest()

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, _, _) in enumerate(self.pieces)}

    @cached_property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def special(self, piece: str, kind: str = CONTROL) -> int:
        """The id of a special piece, or -1 unless it has the type."""
        i = self.ids.get(piece, -1)
        return i if i >= 0 and self.pieces[i][2] == kind else -1

    def piece_id(self, piece: str) -> int:
        return self.ids.get(piece, self.unk)

    def piece(self, i: int) -> str:
        need(0 <= i < len(self.pieces), f"id {i} is out of range")
        return self.pieces[i][0]

    # --- encoding ---

    @cached_property
    def normalize(self) -> Normalizer:
        users = [p for p, _, t in self.pieces if t == USER_DEFINED]
        return Normalizer(replace(self.normalizer, suffix=self.trainer.whitespace_as_suffix), users)

    @cached_property
    def kernel(self):
        rows = list(self.pieces)
        kind = self.trainer.model_type
        return UnigramKernel(rows) if kind == "unigram" else PairKernel(rows) if kind == "bpe" else None

    @cached_property
    def matcher(self) -> PrefixMatcher:
        return PrefixMatcher(p for p, _, t in self.pieces if t == USER_DEFINED)

    @cached_property
    def textual(self) -> dict[str, int]:
        """Pieces that raw text may become: control pieces never do."""
        return {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED)}

    @cached_property
    def by_words(self) -> bool:
        """Whether no piece crosses the beginning of a word, so that words can be encoded one by one."""
        suffix = self.trainer.whitespace_as_suffix
        return self.trainer.model_type in ("unigram", "bpe") and all(
            SPACE not in (p[:-1] if suffix else p[1:]) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED, "UNUSED")
        )

    def segment(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, end, id) of the pieces of a normal form."""
        kind = self.trainer.model_type
        if kind == "unigram":
            return self.kernel.best(text)[0]
        if kind == "bpe":
            return self.kernel.best(text)
        parts = [p for p, _ in self.matcher.split(text)] if kind == "char" else split_words(text, self.trainer.whitespace_as_suffix)
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p), self.textual.get(p, self.unk)))
            at += len(p)
        return out

    def finished(self, text: str, path: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int]]:
        """(piece, id, begin, end): unknown stretches as bytes, or each as one piece."""
        out: list[tuple[str, int, int, int]] = []
        for begin, end, i in path:
            piece = text[begin:end]
            if i != self.unk:
                out.append((piece, i, begin, end))
            elif self.trainer.byte_fallback:
                raw = piece.encode("utf-8", "surrogatepass")
                out += [(byte_piece(b), self.ids[byte_piece(b)], begin, end if k == len(raw) - 1 else begin) for k, b in enumerate(raw)]
            elif out and out[-1][1] == self.unk and out[-1][3] == begin:
                out[-1] = (out[-1][0] + piece, i, out[-1][2], end)
            else:
                out.append((piece, i, begin, end))
        return out

    @cached_property
    def byte_ids(self) -> list[int]:
        return [self.ids[byte_piece(n)] for n in range(256)]

    def finished_ids(self, text: str, path: list[tuple[int, int, int]]) -> list[int]:
        """The ids of ``finished``, without its pieces: texts of unknown letters have one for each byte."""
        unk, fallback = self.unk, self.trainer.byte_fallback
        out: list[int] = []
        last = -1  # where an unknown stretch ended
        for begin, end, i in path:
            if i != unk:
                out.append(i)
            elif fallback:
                out += map(self.byte_ids.__getitem__, text[begin:end].encode("utf-8", "surrogatepass"))
            else:
                if last != begin:
                    out.append(i)
                last = end
        return out

    def pieces_of(self, text: str) -> list[tuple[str, int, int, int]]:
        norm = self.normalize(text)
        return self.finished(norm, self.segment(norm)) if norm else []

    def encode(self, text: str) -> list[int]:
        return [i for _, i, _, _ in self.pieces_of(text)]

    def encode_words(self, text: str, known: dict[str, tuple[int, ...]], most: int = 1 << 20) -> list[int]:
        """The same by words, each worked out once; for models whose pieces don't cross words.

        known: ids by word; a word without its space sign stands under itself, else without the sign.
        """
        norm = self.normalize(text)
        if not norm:
            return []
        if self.trainer.whitespace_as_suffix:
            words = split_words(norm, True)
            parts = [known.get(w) for w in words]
        else:
            # Words but the first begin with the sign; the first may not, and is kept apart then.
            words = norm.split(SPACE)
            begin = words[0]
            words[0] = SPACE + begin if begin else ""
            parts = list(map(known.get, words))
            if not begin:
                del words[0], parts[0]
        if None in parts:
            for n, ids in enumerate(parts):
                if ids is None:
                    word = words[n]
                    if not self.trainer.whitespace_as_suffix:
                        word = word[1:] if n == 0 and begin else SPACE + word
                    ids = parts[n] = known.get(words[n]) or tuple(i for _, i, _, _ in self.finished(word, self.segment(word)))
                    if len(known) < most:
                        known[words[n]] = ids
        if self.trainer.byte_fallback:
            return list(chain.from_iterable(parts))
        out: list[int] = []
        unk = self.unk
        for ids in parts:
            out += ids[1:] if ids[0] == unk and out and out[-1] == unk else ids
        return out

    def spans(self, text: str) -> list[Span]:
        """Pieces with the part of the original text that each covers; offsets are UTF-8 bytes."""
        norm, origin = self.normalize.aligned(text)
        if not norm:
            return []
        raw, at = text.encode("utf-8", "surrogatepass"), byte_offsets(norm)
        out = []
        for piece, i, begin, end in self.finished(norm, self.segment(norm)):
            a, b = origin[at[begin]], origin[at[end]]
            out.append(Span(piece, i, raw[a:b].decode("utf-8", "replace"), a, b))
        return out

    def nbest(self, text: str, size: int) -> list[list[int]]:
        need(self.trainer.model_type == "unigram", "n-best is for unigram models")
        norm = self.normalize(text)
        return [[i for _, i, _, _ in self.finished(norm, p)] for p, _ in self.kernel.nbest(norm, size)]

    def sample(self, text: str, alpha: float, seed: int, size: int = -1) -> list[int]:
        """A segmentation drawn at random; the seed and the text settle it."""
        kind = self.trainer.model_type
        need(kind in ("unigram", "bpe"), "sampling is for unigram and bpe models")
        norm = self.normalize(text)
        rng = random.Random(f"{seed}:{norm}")
        path = self.kernel.sample_nbest(norm, size, alpha, rng) if kind == "unigram" else self.kernel.best(norm, alpha, rng)
        return [i for _, i, _, _ in self.finished(norm, path)]

    def options(self, spec: str):
        """A function of id lists for options such as ``bos:eos:reverse``, applied in order."""
        steps = []
        for name in filter(None, spec.split(":")):
            need(name in ("bos", "eos", "reverse", "unk", "unk_piece"), f"unknown option {name!r}")
            i = -1
            if name in ("bos", "eos"):
                i = self.special(getattr(self.trainer, f"{name}_piece"))
                need(i >= 0, f"the model has no {name} piece")
            steps.append((name, i))

        def apply(ids: list[int]) -> list[int]:
            for name, i in steps:
                ids = [i, *ids] if name == "bos" else [*ids, i] if name == "eos" else ids[::-1] if name == "reverse" else ids
            return ids

        return apply

    def piece_options(self, spec: str):
        """The same for lists of (piece, id), giving pieces; ``unk`` and ``unk_piece`` put the unknown piece in place of unknown stretches."""
        self.options(spec)
        names = list(filter(None, spec.split(":")))

        def apply(found: list[tuple[str, int]]) -> list[str]:
            for name in names:
                if name in ("bos", "eos"):
                    own = getattr(self.trainer, f"{name}_piece"), self.special(getattr(self.trainer, f"{name}_piece"))
                    found = [own, *found] if name == "bos" else [*found, own]
                elif name == "reverse":
                    found = found[::-1]
                else:
                    found = [(self.trainer.unk_piece, i) if i == self.unk else (p, i) for p, i in found]
            return [p for p, _ in found]

        return apply

    # --- decoding ---

    @cached_property
    def denormalize(self) -> Normalizer | None:
        if self.denormalizer is None:
            return None
        return Normalizer(replace(self.denormalizer, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))

    def decoded(self, pieces: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """(surface, id) of each (piece, id), before denormalising."""
        n, out, text = self.normalizer, [], False
        strip = n.add_dummy_prefix or n.remove_extra_whitespaces
        suffix = self.trainer.whitespace_as_suffix
        i = 0
        while i < len(pieces):
            piece, own = pieces[i]
            kind = self.pieces[own][2] if 0 <= own < len(self.pieces) else UNKNOWN
            if kind == CONTROL:
                surface = ""
            elif kind == UNKNOWN:
                surface = self.trainer.unk_surface if piece == self.pieces[self.unk][0] else piece
                text = True
            elif kind == BYTE:
                j = i
                while j < len(pieces) and 0 <= pieces[j][1] < len(self.pieces) and self.pieces[pieces[j][1]][2] == BYTE:
                    j += 1
                raw = bytes(int(BYTE_PIECE.fullmatch(p)[1], 16) for p, _ in pieces[i:j])
                decoded = raw.decode("utf-8", "one_by_one")
                out += [("", pieces[k][1]) for k in range(i, j - 1)] + [(decoded, pieces[j - 1][1])]
                text, i = True, j
                continue
            else:
                surface = piece
                if not text and strip and not suffix:
                    if n.remove_extra_whitespaces:
                        surface = surface.lstrip(SPACE)
                    elif surface.startswith(SPACE):
                        surface = surface[1:]
                        text = True
                if surface:
                    text = True
                surface = surface.replace(SPACE, " ")
            out.append((surface, own))
            i += 1
        if suffix and strip and out:
            k = next((k for k in range(len(out) - 1, -1, -1) if out[k][0]), None)
            if k is not None:
                out[k] = (out[k][0].removesuffix(" "), out[k][1])
        return out

    def decode(self, ids: list[int]) -> str:
        text = "".join(s for s, _ in self.decoded([(self.piece(i), i) for i in ids]))
        return self.denormalize(text) if self.denormalize else text

    def decode_pieces(self, pieces: list[str]) -> str:
        text = "".join(s for s, _ in self.decoded([(p, self.piece_id(p)) for p in pieces]))
        return self.denormalize(text) if self.denormalize else text

    def decode_spans(self, ids: list[int]) -> list[Span]:
        """Pieces with the part of the decoded text, before denormalising, that each becomes; offsets are bytes."""
        out, at = [], 0
        for (surface, i), own in zip(self.decoded([(self.piece(i), i) for i in ids]), ids):
            n = len(surface.encode("utf-8", "surrogatepass"))
            out.append(Span(self.piece(own), i, surface, at, at + n))
            at += n
        return out


def special_layout(spec: TrainerSpec) -> dict[int, tuple[str, str]]:
    """Where special pieces stand: unknown, begin, end and padding at their ids, then control, user-defined and byte pieces at the lowest free ones."""
    out: dict[int, tuple[str, str]] = {}
    for i, piece, kind in ((spec.unk_id, spec.unk_piece, UNKNOWN), (spec.bos_id, spec.bos_piece, CONTROL), (spec.eos_id, spec.eos_piece, CONTROL), (spec.pad_id, spec.pad_piece, CONTROL)):
        if i >= 0:
            need(i not in out, f"two special pieces at id {i}")
            need(piece not in {p for p, _ in out.values()}, f"special piece {piece!r} stands twice")
            out[i] = (piece, kind)
    free = (i for i in range(1 << 30) if i not in out)
    seen: set[str] = set()

    def put(piece: str, kind: str) -> None:
        need(piece, "an empty symbol")
        need(piece not in seen, f"symbol {piece!r} stands twice")
        seen.add(piece)
        need(piece != spec.unk_piece, f"{piece!r} can't be redefined")
        at = next((i for i, (p, _) in out.items() if p == piece), None)
        out[next(free) if at is None else at] = (piece, kind)

    for s in spec.control_symbols:
        put(s, CONTROL)
    for s in spec.user_defined_symbols:
        put(s, USER_DEFINED)
        if spec.model_type == "word":
            put(SPACE + s, USER_DEFINED)
    if spec.byte_fallback:
        for n in range(256):
            put(byte_piece(n), BYTE)
    return out


def assemble(spec: TrainerSpec, learnt: list[tuple[str, float]], normalizer: NormalizerSpec = NormalizerSpec(), must: int = 0) -> Model:
    """A model of learnt (piece, score) pairs, best first, around the special pieces.

    must: how many pieces a soft limit of the vocabulary leaves in any case.
    """
    special = special_layout(spec)
    taken = {p for p, _ in special.values()}
    if len(taken & {p for p, _ in learnt}):
        learnt = [x for x in learnt if x[0] not in taken]
    need(len({p for p, _ in learnt}) == len(learnt), "a learnt piece stands twice")
    room = spec.vocab_size - len(special)
    soft = not spec.hard_vocab_limit or spec.model_type == "char" or spec.use_all_vocab
    if not soft and len(learnt) < room:
        raise SpecError(f"vocabulary of {spec.vocab_size} is too large: only {len(learnt) + len(special)} pieces; set a smaller one or hard_vocab_limit=False")
    if not spec.use_all_vocab:
        learnt = learnt[: max(0, room, must if soft else 0)]
    size = len(special) + len(learnt)
    need(not special or max(special) < size, "a special id lies beyond the vocabulary")
    rest = iter(learnt)
    rows = []
    for i in range(size):
        if i in special:
            rows.append((special[i][0], 0.0, special[i][1]))
        else:
            p, s = next(rest)
            rows.append((p, float(s), NORMAL))
    return Model(tuple(rows), spec, normalizer).checked()
