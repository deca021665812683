"""Models in files: a directory of a vocabulary table and options, lines of text, and the public wire format."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import valid_piece_column
from ..kernels.model import Model
from ..operators.vocabulary import exported, model_pieces, vocabulary
from ..spec import TYPE_NUMBERS, TYPES, NormalizerSpec, SpecError, TrainerSpec, need


def save(spark: SparkSession, model: Model, path: str) -> None:
    """A directory with ``vocab`` (parquet) and ``spec`` (one line of JSON), on any file system Spark writes."""
    vocabulary(spark, model).write.mode("overwrite").parquet(f"{path}/vocab")
    spec = {"trainer": asdict(model.trainer), "normalizer": asdict(model.normalizer), "denormalizer": model.denormalizer and asdict(model.denormalizer)}
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def _spec(kind: type, values: dict | None):
    if values is None:
        return None
    known = {f.name for f in fields(kind)}
    deep = lambda v: tuple(map(deep, v)) if isinstance(v, list) else v
    return kind(**{k: deep(v) for k, v in values.items() if k in known})


def load(spark: SparkSession, path: str) -> Model:
    need(path, "an empty model name")
    spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
    return Model(model_pieces(spark.read.parquet(f"{path}/vocab")), _spec(TrainerSpec, spec["trainer"]), _spec(NormalizerSpec, spec["normalizer"]), _spec(NormalizerSpec, spec["denormalizer"])).checked()


def write_lines(vocab: DataFrame, path: str, form: str = "vocab") -> None:
    """Lines of a vocabulary in the order of ids, as one file: a vocabulary is small."""
    exported(vocab, form).orderBy("piece_id").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_merges(spark: SparkSession, merges: list[tuple[str, str] | tuple[str, str, int]], path: str) -> None:
    """Lines of left, right and, for a merge of one level of a hierarchy, its level, in the order of ranks, as one file."""
    spark.createDataFrame([(n, "\t".join(map(str, m))) for n, m in enumerate(merges)], "rank int, value string").coalesce(1).sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``rank, value``: the lines of one file of the size of a vocabulary, numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\n\\z", "").alias("value")).filter("value <> ''")
    return whole.select(F.posexplode(F.split("value", "\n", -1)).alias("rank", "value"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """``rank, left, right, level`` of lines of two pieces and maybe a level, with TAB between."""
    parts = F.split("value", "\t", -1)
    return numbered_lines(spark, path).select("rank", F.element_at(parts, 1).alias("left"), F.element_at(parts, 2).alias("right"), F.try_element_at(parts, F.lit(3)).try_cast("int").alias("level"))


def read_seeds(spark: SparkSession, path: str, most: int = 1_000_000, spec: TrainerSpec = TrainerSpec()) -> DataFrame:
    """``piece, value``: seeds of lines of piece and frequency; other lines and pieces of a shape that the options forbid are skipped. The value is frequency times characters."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).filter(F.size(parts) == 2).select(F.element_at(parts, 1).alias("piece"), F.element_at(parts, 2).alias("f"))
    rows = rows.withColumn("f", F.expr("try_cast(f as bigint)")).filter("f > 0 and piece <> ''").filter(valid_piece_column("piece", spec))
    return rows.select("piece", (F.col("f") * F.char_length("piece")).alias("value")).orderBy(F.col("value").desc(), "piece").limit(most)


def read_symbols(spark: SparkSession, path: str) -> list[str]:
    """Symbols, required characters or protected pieces, one a line, in order; empty lines are skipped."""
    return [r.value for r in numbered_lines(spark, path).filter("value <> ''").orderBy("rank").collect()]


# --- wire format --------------------------------------------------------------------------------

# Numbers of the fields of the public model format.
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
PIECE, SCORE, TYPE = 1, 2, 3
MODEL_TYPES = {"unigram": 1, "bpe": 2, "word": 3, "char": 4}
TRAINER_FIELDS = {
    "model_type": (3, "model"), "vocab_size": (4, "int"), "character_coverage": (10, "float"), "input_sentence_size": (11, "int"), "seed_size": (14, "int"),
    "shrinking_factor": (15, "float"), "num_sub_iterations": (17, "int"), "max_sentence_length": (18, "int"), "shuffle_input_sentence": (19, "bool"),
    "max_piece_length": (20, "int"), "split_by_script": (21, "bool"), "split_by_whitespace": (22, "bool"), "split_by_number": (23, "bool"),
    "whitespace_as_suffix": (24, "bool"), "split_digits": (25, "bool"), "allow_whitespace_only": (26, "bool"), "control_symbols": (30, "strings"),
    "user_defined_symbols": (31, "strings"), "hard_vocab_limit": (33, "bool"), "use_all_vocab": (34, "bool"), "byte_fallback": (35, "bool"),
    "required_chars": (36, "string"), "unk_id": (40, "int"), "bos_id": (41, "int"), "eos_id": (42, "int"), "pad_id": (43, "int"), "unk_surface": (44, "string"),
    "unk_piece": (45, "string"), "bos_piece": (46, "string"), "eos_piece": (47, "string"), "pad_piece": (48, "string"), "pretokenization_delimiter": (53, "string"),
    "split_by_interval": (200, "bool"), "split_by_barline": (201, "bool"),
}
NORMALIZER_FIELDS = {"name": (1, "string"), "add_dummy_prefix": (3, "bool"), "remove_extra_whitespaces": (4, "bool"), "escape_whitespaces": (5, "bool")}
RULE_BLOB = 2


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def wire_fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            need(at < len(raw) and shift < 70, "the model can't be parsed")
            b = raw[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while at < len(raw):
        tag = number()
        kind, value = tag & 7, None
        if kind == 0:
            value = number()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            need(at + size <= len(raw), "the model can't be parsed")
            value = raw[at : at + size]
            at += size
        elif kind == 2:
            size = number()
            need(at + size <= len(raw), "the model can't be parsed")
            value = raw[at : at + size]
            at += size
        else:
            raise SpecError("the model can't be parsed")
        yield tag >> 3, kind, value


def _field(n: int, kind: str, value) -> bytes:
    if kind == "strings":
        return b"".join(_field(n, "string", v) for v in value)
    if kind in ("string", "bytes"):
        raw = value.encode() if kind == "string" else value
        return varint(n << 3 | 2) + varint(len(raw)) + raw
    if kind == "float":
        return varint(n << 3 | 5) + struct.pack("<f", value)
    return varint(n << 3) + varint(MODEL_TYPES[value] if kind == "model" else int(value))


def _read(table: dict, raw: bytes) -> dict:
    names = {n: (k, kind) for k, (n, kind) in table.items()}
    out: dict = {}
    for n, _, v in wire_fields(raw):
        if n not in names:
            continue
        k, kind = names[n]
        if kind == "strings":
            out[k] = (*out.get(k, ()), v.decode())
        elif kind == "string":
            out[k] = v.decode()
        elif kind == "float":
            out[k] = round(struct.unpack("<f", v)[0], 7)
        elif kind == "bool":
            out[k] = bool(v)
        elif kind == "model":
            out[k] = {n: t for t, n in MODEL_TYPES.items()}[v]
        else:
            out[k] = v - (1 << 64) if v >> 63 else v
    return out


def to_wire(model: Model) -> bytes:
    """The model in the public format. Rules given by name travel by name."""
    out = [_field(PIECES, "bytes", _field(PIECE, "string", p) + _field(SCORE, "float", s) + (_field(TYPE, "int", TYPE_NUMBERS[t]) if t != "NORMAL" else b"")) for p, s, t in model.pieces]
    out.append(_field(TRAINER, "bytes", b"".join(_field(n, kind, getattr(model.trainer, k)) for k, (n, kind) in TRAINER_FIELDS.items())))
    for n, spec in ((NORMALIZER, model.normalizer), (DENORMALIZER, model.denormalizer)):
        if spec is not None:
            out.append(_field(n, "bytes", b"".join(_field(k, kind, getattr(spec, name)) for name, (k, kind) in NORMALIZER_FIELDS.items())))
    return b"".join(out)


def from_wire(raw: bytes) -> Model:
    """A model out of the public format; its rule blob, where there is one, becomes rules."""
    need(raw, "an empty model")
    pieces, trainer, normalizer, denormalizer = [], {}, NormalizerSpec("identity"), None
    numbers = {n: t for t, n in TYPE_NUMBERS.items()}
    for n, _, v in wire_fields(raw):
        if n == PIECES:
            own = {k: x for k, _, x in wire_fields(v)}
            pieces.append((own.get(PIECE, b"").decode(), struct.unpack("<f", own.get(SCORE, b"\0\0\0\0"))[0], numbers[own.get(TYPE, 1)]))
        elif n == TRAINER:
            trainer = _read(TRAINER_FIELDS, v)
        elif n in (NORMALIZER, DENORMALIZER):
            blob = next((x for k, _, x in wire_fields(v) if k == RULE_BLOB), b"")
            spec = NormalizerSpec(**_read(NORMALIZER_FIELDS, v) | ({"rules": tuple(sorted(read_rule_blob(blob).items()))} if blob else {}))
            normalizer, denormalizer = (spec, denormalizer) if n == NORMALIZER else (normalizer, spec)
    return Model(tuple(pieces), TrainerSpec(**trainer), normalizer, denormalizer).checked()


def read_rule_blob(blob: bytes) -> dict[str, str]:
    """Rules of a blob: the size of a double-array trie, the trie, and targets that end in NUL."""
    need(len(blob) > 4, "the rule blob is broken")
    size = struct.unpack("<I", blob[:4])[0]
    need(size < len(blob) - 4 and size >= 1024 and size % 1024 == 0, "the rule trie's size is wrong")
    units, targets = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size]), blob[4 + size :]
    need(targets and targets[-1] == 0, "the rule targets don't end in NUL")
    out: dict[str, str] = {}
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    stack = [(offset(units[0]), b"")]
    while stack:
        base, key = stack.pop()
        need(len(key) < 1000, "the rule trie is too deep")
        for b in range(1, 256):
            at = base ^ b
            if at < len(units) and units[at] & ((1 << 31) | 0xFF) == b:
                below = at ^ offset(units[at])
                if units[at] >> 8 & 1:
                    begin = units[below] & 0x7FFFFFFF
                    need(begin < len(targets), "a rule target lies outside the blob")
                    out[(key + bytes([b])).decode()] = targets[begin : targets.index(0, begin)].decode()
                stack.append((below, key + bytes([b])))
    return out


def write_rule_blob(rules: dict[str, str]) -> bytes:
    """A blob of rules: children of each node are placed at the first base where all of them fit."""
    need(rules, "no rules")
    targets, places = bytearray(), {}
    for t in sorted(set(rules.values())):
        places[t] = len(targets)
        targets += t.encode() + b"\0"
    tree: dict = {}
    for s, t in rules.items():
        node = tree
        for b in s.encode():
            node = node.setdefault(b, {})
        node[0] = places[t]
    units: dict[int, int] = {}
    used = {0}
    bases: set[int] = set()
    free = 1

    def place(at: int, node: dict, label: int) -> None:
        nonlocal free
        labels = sorted(node)
        while free in used:
            free += 1
        first = free
        while True:
            base = first ^ labels[0]
            far = base ^ at
            small = far < 1 << 21 or (far & 0xFF == 0 and far < 1 << 29)
            if first not in used and base and small and base not in bases and all(base ^ b not in used for b in labels):
                break
            first += 1
        bases.add(base)
        used.update(base ^ b for b in labels)
        far = base ^ at
        units[at] = (far << 10 if far < 1 << 21 else far << 2 | 1 << 9) | (1 << 8 if 0 in node else 0) | label
        for b in labels:
            if b == 0:
                units[base] = node[0] | 1 << 31
            else:
                place(base ^ b, node[b], b)

    place(0, tree, 0)
    n = -(-(max(units) + 1) // 256) * 256
    trie = struct.pack(f"<{n}I", *(units.get(i, 0) for i in range(n)))
    return struct.pack("<I", len(trie)) + trie + bytes(targets)
