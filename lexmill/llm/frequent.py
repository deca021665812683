"""Problem 2: the most frequent items of a column with too many distinct values.

External sort with run-length counting. Each partition is cut into sorted runs in which equal
values are combined; a range exchange puts all runs of a value into one range, where the runs
are merged by a (spilling) sort and equal neighbours are added up; of each range only a bounded
heap of candidates leaves the task. A value with at least ``share`` of the grand total has at
least that share of its range, so it is among the ``1/share`` heaviest of its range: the heap
bound loses nothing, and the counts are exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

RUN_ROWS = 200_000
RUNS = "field string, item string, weight bigint"
CANDIDATES = "field string, item string, weight bigint, range_total decimal(38,0)"


def _combined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    run = pa.Table.from_batches(parts).group_by(["field", "item"]).aggregate([("weight", "sum")])
    run = run.rename_columns(["field", "item", "weight"]).sort_by([("field", "ascending"), ("item", "ascending")])
    return run.combine_chunks().to_batches()[0]


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of at most RUN_ROWS rows read, equal values combined; what repeats shrinks on."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= RUN_ROWS:
            run = _combined(held)
            # A run that shrank well stays and takes further rows in; else it is let go.
            held, rows = ([run], run.num_rows) if run.num_rows < RUN_ROWS // 2 else ([], 0)
            if not held:
                yield run
    if held:
        yield _combined(held)


def _heaviest(bound: int):
    """Adds up equal neighbours of a sorted range and keeps its ``bound`` heaviest values for each field."""

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list] = {}
        totals: dict[str, int] = {}
        last, weight = None, 0

        def close() -> None:
            if last is not None:
                heap = heaps.setdefault(last[0], [])
                totals[last[0]] = totals.get(last[0], 0) + weight
                entry = (weight, last[1])
                if len(heap) < bound:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            field, item = b.column("field"), b.column("item")
            w = b.column("weight").to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = pc.or_(pc.not_equal(field[1:], field[:-1]), pc.not_equal(item[1:], item[:-1])).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(w, starts)
            names = field.take(pa.array(starts)).to_pylist()
            # Only a run at the edge of the batch can go on, and only the heaviest can stay.
            edge = {0, len(starts) - 1}
            for name in dict.fromkeys(names):
                own = np.flatnonzero(np.array([x == name for x in names])) if len(set(names)) > 1 else np.arange(len(starts))
                inner = own[(own != 0) & (own != len(starts) - 1)]
                totals[name] = totals.get(name, 0) + int(sums[inner].sum())
                heap = heaps.setdefault(name, [])
                if len(inner) > bound:
                    least = np.partition(sums[inner], len(inner) - bound)[len(inner) - bound]
                    inner = inner[sums[inner] >= max(least, heap[0][0] if len(heap) == bound else least)]
                for i in inner.tolist():
                    entry = (int(sums[i]), item[int(starts[i])].as_py())
                    if len(heap) < bound:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            for i in sorted(edge):
                key = (names[i], item[int(starts[i])].as_py())
                if key == last:
                    weight += int(sums[i])
                else:
                    close()
                    last, weight = key, int(sums[i])
        close()
        rows = [(f, x, n, None) for f, heap in heaps.items() for n, x in heap] + [(f, None, None, n) for f, n in totals.items()]
        if rows:
            f, x, n, t = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(x, pa.string()), pa.array(n, pa.int64()), pa.array(t, pa.decimal128(38, 0))], names=["field", "item", "weight", "range_total"])

    return ranged


def most_frequent(df: DataFrame, share: float = 0.005, ranges: int | None = None) -> DataFrame:
    """The values with at least ``share`` of their field's total weight.

    df: ``field STRING, item STRING, weight BIGINT``, one row for each observation. Returns
    ``field, item, weight, total, share``. Rows with a null field, item or weight don't count, nor
    do weights below 1; the empty string is a value like others; ties are all returned; an empty
    input gives no row. Other columns are ignored.
    """
    spark = df.sparkSession
    bound = math.ceil(1 / share)
    rows = df.select("field", "item", "weight").filter("field is not null and item is not null and weight > 0")
    # The exchange by ranges reads its input twice, for their bounds and for itself: the runs are written once.
    runs = cut(rows.mapInArrow(sorted_runs, RUNS))
    ranged = runs.repartitionByRange(ranges or spread(spark), "field", "item").sortWithinPartitions("field", "item")
    # One row a range and value from here on: at most ranges x bound rows, and for each field one row a range with its total.
    heavy = cut(ranged.mapInArrow(_heaviest(bound), CANDIDATES))
    totals = heavy.filter("item is null").groupBy("field").agg(F.sum("range_total").cast("decimal(38,0)").alias("total"))
    return (
        heavy.filter("item is not null")
        .join(totals, "field")
        .filter(F.col("weight") >= F.col("total") * F.lit(share).cast("decimal(18,9)"))
        .select("field", "item", "weight", F.col("total").cast("bigint").alias("total"), (F.col("weight") / F.col("total").cast("double")).alias("share"))
    )
