"""Options of training and normalising, and the schemas of vocabularies and merge programs."""

from __future__ import annotations

from dataclasses import dataclass

SPACE = "▁"  # stands for a blank inside pieces
RARE = "▅"  # stands for characters outside the covered alphabet while training
BOUNDARY = "\x1f"  # no piece crosses it
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = "NORMAL", "UNKNOWN", "CONTROL", "USER_DEFINED", "UNUSED", "BYTE"
TYPES = (NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE)
# Numbers of the types in the public model format.
TYPE_NUMBERS = {"NORMAL": 1, "UNKNOWN": 2, "CONTROL": 3, "USER_DEFINED": 4, "UNUSED": 5, "BYTE": 6}
VOCABULARY = "piece_id int, piece string, score float, type string"
MERGES = "rank int, left string, right string, piece string"
UNKNOWN_SURFACE = " ⁇ "
UNKNOWN_PENALTY = 10.0


class SpecError(ValueError):
    """An option, a vocabulary or a program that isn't valid."""


def need(ok: object, message: str) -> None:
    if not ok:
        raise SpecError(message)


@dataclass(frozen=True)
class NormalizerSpec:
    """How text is brought to its normal form.

    rules: source to target strings, the longest source first; a target may be empty.
    """

    name: str = "nmt_nfkc"
    rules: tuple[tuple[str, str], ...] | None = None
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    suffix: bool = False


@dataclass(frozen=True)
class TrainerSpec:
    model_type: str = "unigram"
    vocab_size: int = 8000
    character_coverage: float = 0.9995
    input_sentence_size: int = 0
    shuffle_input_sentence: bool = True
    max_sentence_length: int = 4192
    seed_size: int = 1_000_000
    shrinking_factor: float = 0.75
    num_sub_iterations: int = 2
    max_piece_length: int = 16
    split_by_script: bool = True
    split_by_number: bool = True
    split_by_whitespace: bool = True
    whitespace_as_suffix: bool = False
    allow_whitespace_only: bool = False
    split_digits: bool = False
    split_by_interval: bool = False
    split_by_barline: bool = False
    pretokenization_delimiter: str = ""
    control_symbols: tuple[str, ...] = ()
    user_defined_symbols: tuple[str, ...] = ()
    required_chars: str = ""
    byte_fallback: bool = False
    hard_vocab_limit: bool = True
    use_all_vocab: bool = False
    unk_id: int = 0
    bos_id: int = 1
    eos_id: int = 2
    pad_id: int = -1
    unk_piece: str = "<unk>"
    bos_piece: str = "<s>"
    eos_piece: str = "</s>"
    pad_piece: str = "<pad>"
    unk_surface: str = UNKNOWN_SURFACE
    sparse_pruning: bool = False
    auto_character_coverage: bool = False
    seed_length_power: float = 1.0

    def validated(self) -> TrainerSpec:
        between = lambda name, lo, hi: need(lo <= getattr(self, name) <= hi, f"{name} must be from {lo} to {hi}")
        need(self.model_type in ("unigram", "bpe", "word", "char"), f"unknown model type {self.model_type!r}")
        need(self.vocab_size > 0, "vocab_size must be above 0")
        need(not self.use_all_vocab or self.model_type in ("word", "char"), "use_all_vocab is for word and char models")
        between("character_coverage", 0.98, 1.0)
        between("max_piece_length", 1, 512)
        between("num_sub_iterations", 1, 10)
        between("shrinking_factor", 0.5, 0.95)
        between("max_sentence_length", 10, 1 << 30)
        need(self.input_sentence_size == 0 or self.input_sentence_size > 100, "input_sentence_size must be 0 or above 100")
        need(all((self.unk_piece, self.bos_piece, self.eos_piece, self.pad_piece)), "special pieces must not be empty")
        need(self.unk_id >= 0, "unk_id must be set")
        need(not self.auto_character_coverage or (self.byte_fallback and not self.required_chars), "auto coverage needs byte_fallback and no required characters")
        return self
