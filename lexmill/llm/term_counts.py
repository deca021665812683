"""Problem 3: how often every term occurs, and in how many records.

Vertical layout: for each term and each block of 65,536 record identifiers a container holds the
records the term occurs in (a sorted array of 16-bit offsets, or from 4,096 of them on a bitmap of
8 KB, so that no array has a bitmap's length), next to a counter of occurrences. Containers are built inside each partition, so what a
frequent term sends is a container a block and not its rows; equal (term, block) containers are
then merged by union, and the document frequency is the sum of the cardinalities over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

BUILD_ROWS = 400_000
ARRAY_MOST = 4095
BITMAP_BYTES = 8192
CONTAINERS = "field string, term string, block bigint, records binary, occurrences bigint"
COUNTS = "field string, term string, block bigint, records bigint, occurrences bigint"


def pack(lows: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """Containers of the groups that begin at ``starts`` in ``lows`` (sorted within each group, unique)."""
    ends = np.append(starts[1:], len(lows))
    sizes = ends - starts
    large = np.flatnonzero(sizes > ARRAY_MOST)
    if not len(large):
        offsets = np.append(starts, len(lows)).astype(np.int32) * 2
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(lows.astype("<u2").tobytes())])
    raw = lows.astype("<u2")
    big = set(large.tolist())
    out = []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        if i in big:
            bits = np.zeros(65536, np.uint8)
            bits[raw[a:b]] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        else:
            out.append(raw[a:b].tobytes())
    return pa.array(out, pa.binary())


def unpack(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All offsets of the containers, and for each offset the number of its container."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4))
    if BITMAP_BYTES + 1 > sizes.max(initial=0) and not (sizes == BITMAP_BYTES).any():
        first = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]
        data = np.frombuffer(column.buffers()[2], "<u2", int(sizes.sum()) // 2, int(first)) if sizes.sum() else np.empty(0, "<u2")
        return data, np.repeat(np.arange(len(column)), sizes // 2)
    lows, owner = [], []
    for i, x in enumerate(column.to_pylist()):
        v = np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")).astype("<u2") if len(x) == BITMAP_BYTES else np.frombuffer(x, "<u2")
        lows.append(v)
        owner.append(np.full(len(v), i))
    return np.concatenate(lows), np.concatenate(owner)


def _codes(t: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A dense number for each row's key, and for each key one row that has it."""
    keyed = t.select(names).append_column("__row", pa.array(np.arange(t.num_rows)))
    groups = keyed.group_by(names).aggregate([("__row", "min")]).combine_chunks()
    key = groups.append_column("__code", pa.array(np.arange(groups.num_rows)))
    joined = keyed.join(key.drop_columns(["__row_min"]), names, join_type="left outer").sort_by("__row")
    return joined.column("__code").to_numpy(), groups.column("__row_min").to_numpy()


def _build(t: pa.Table) -> pa.RecordBatch:
    """Containers of rows field, term, record, occurrences."""
    records = t.column("record").to_numpy()
    t = t.append_column("block", pa.array(records >> 16))
    code, example = _codes(t, ["field", "term", "block"])
    occurrences = np.bincount(code, minlength=len(example)) if "occurrences" not in t.column_names else _sums(code, t.column("occurrences").to_numpy(), len(example))
    full = np.unique((code.astype(np.int64) << 16) | (records & 0xFFFF))
    owner = full >> 16
    starts = np.searchsorted(owner, np.arange(len(example)))
    keys = t.select(["field", "term", "block"]).take(pa.array(example)).combine_chunks()
    cols = [keys.column(c).combine_chunks() for c in ("field", "term", "block")]
    return pa.RecordBatch.from_arrays([*cols, pack(full & 0xFFFF, starts), pa.array(occurrences, pa.int64())], names=["field", "term", "block", "records", "occurrences"])


def _sums(code: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, code, values)
    return out


def containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BUILD_ROWS:
            yield _build(pa.Table.from_batches(held))
            held, rows = [], 0
    if held:
        yield _build(pa.Table.from_batches(held))


def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of containers sorted by key: the cardinality of each key's union and its occurrences."""
    carry: pa.Table | None = None
    names = ["field", "term", "block"]

    def counted(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        code, example = _codes(t, names)
        lows, row = unpack(t.column("records").combine_chunks() if isinstance(t.column("records"), pa.ChunkedArray) else t.column("records"))
        full = np.unique((code[row].astype(np.int64) << 16) | lows)
        cards = np.bincount(full >> 16, minlength=len(example))
        keys = t.select(names).take(pa.array(example)).combine_chunks()
        cols = [keys.column(c).combine_chunks() for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(cards, pa.int64()), pa.array(_sums(code, t.column("occurrences").to_numpy(), len(example)))], names=[*names, "records", "occurrences"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        last = t.slice(t.num_rows - 1).to_pylist()[0]
        # Rows of the last key wait for the next batch.
        n, keep = t.num_rows, 0
        cols = [t.column(c) for c in names]
        while keep < n and all(c[n - 1 - keep].as_py() == last[k] for c, k in zip(cols, names)):
            keep += 1
        if keep < n:
            yield counted(t.slice(0, n - keep))
        carry = t.slice(n - keep)
        if carry.num_rows > 64:  # many containers of one key: one container again
            carry = _merged(carry)
    if carry is not None:
        yield counted(carry)


def _merged(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    lows, _ = unpack(t.column("records").combine_chunks())
    one = pack(np.unique(lows), np.array([0]))
    head = t.slice(0, 1).to_pylist()[0]
    return pa.table({"field": [head["field"]], "term": [head["term"]], "block": pa.array([head["block"]], pa.int64()), "records": one, "occurrences": pa.array([int(np.sum(t.column("occurrences").to_numpy()))], pa.int64())}, schema=t.schema)


def term_counts(df: DataFrame) -> DataFrame:
    """``field, term, occurrences, records`` for every term.

    df: ``field STRING, term STRING, record BIGINT, occurrences BIGINT``. A record may hold a
    term in many rows; it counts once in ``records``, and each row adds to ``occurrences`` (a
    null there adds nothing). Rows without field, term or record are left out; the empty string
    is a term. Records may be any 64-bit number, negative ones too. An empty input gives no row;
    other columns are ignored.
    """
    rows = df.select("field", "term", F.col("record").cast("bigint").alias("record"), F.coalesce(F.col("occurrences").cast("bigint"), F.lit(0)).alias("occurrences"))
    rows = rows.filter("field is not null and term is not null and record is not null")
    key = ["field", "term", "block"]
    built = rows.mapInArrow(containers, CONTAINERS).repartition(spread(df.sparkSession), *key).sortWithinPartitions(*key)
    return built.mapInArrow(unions, COUNTS).groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, totals: DataFrame, rules: dict[str, tuple[str, int, float]]) -> DataFrame:
    """counts with ``marks ARRAY<STRING>``: 'rare' and 'common', both, or none.

    totals: ``field, n_records``, one row a field (as many rows as ``rules``). rules: for each
    field the counter of rareness ('occurrences' or 'records'), the number below which a term is
    rare, and the share of all records above which it is common.
    """
    rare, common = F.lit(False), F.lit(False)
    for field, (counter, least, most) in rules.items():
        own = F.col("field") == field
        rare = rare | (own & (F.col(counter) < least))
        common = common | (own & (F.col("records") > F.col("n_records") * F.lit(most).cast("decimal(9,6)")))
    marks = F.array_compact(F.array(F.when(rare, "rare"), F.when(common, "common")))
    return counts.join(F.broadcast(totals), "field").withColumn("marks", marks)
