"""Deliveries, frequent items, term counts, mixing."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import frequent, mixing, term_counts
from lexmill.llm.deliveries import first_delivery

ITEMS = "field string, item string, weight bigint, run int"
TERMS = "field string, term string, record bigint, occurrences bigint, block int"


def test_first_delivery_keeps_one_and_nulls(spark):
    rows = [(1, "b", 2), (1, "a", 1), (1, "a", 1), (2, "c", 5), (None, "x", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "id int, v string, at int").withColumnRenamed("v", "__nth")
    got = sorted((r[0] or 0, r[1]) for r in first_delivery(df, ["id"], ["at", "__nth"]).collect())
    assert got == [(0, "x"), (0, "x"), (1, "a"), (2, "c")]
    assert first_delivery(df.limit(0), ["id"], ["at"]).collect() == []


def brute_frequent(rows, share):
    sums, totals = Counter(), Counter()
    for f, x, w, _ in rows:
        if f is not None and x is not None and w and w > 0:
            sums[f, x] += w
            totals[f] += w
    return {(f, x, n) for (f, x), n in sums.items() if n >= share * totals[f]}


@pytest.mark.parametrize("share", [0.3, 0.05, 0.01])
def test_most_frequent_against_brute_force(spark, share):
    rng = np.random.default_rng(1)
    rows = [("piece", "hot", 5, 1)] * 900 + [("piece", f"p{int(rng.zipf(1.4)) % 400}", int(rng.integers(1, 9)), 1) for _ in range(3000)]
    rows += [("score", str(n % 23), 1, 1) for n in range(700)] + [("score", None, 1, 1), (None, "x", 4, 1), ("piece", "", 300, 1), ("piece", "neg", -5, 1), ("piece", "null", None, 1)]
    got = frequent.most_frequent(spark.createDataFrame(rows, ITEMS).repartition(5), share, 3)
    assert {(r.field, r.item, r.weight) for r in got.collect()} == brute_frequent(rows, share)


def test_most_frequent_ties_and_empty(spark):
    rows = [("piece", x, 1, 0) for x in "abcd"]
    df = spark.createDataFrame(rows, ITEMS)
    assert {r.item for r in frequent.most_frequent(df, 0.25).collect()} == set("abcd")
    assert frequent.most_frequent(df.limit(0)).collect() == []


def test_runs_and_heaps_over_many_batches():
    """A value across batches, and more values than the heap holds."""
    items = sorted(f"v{n:05d}" for n in range(5000))
    table = pa.table({"field": ["f"] * 5000, "item": items, "weight": pa.array(range(5000), pa.int64())})
    long = pa.table({"field": ["f"] * 900, "item": ["zz"] * 900, "weight": pa.array([7] * 900, pa.int64())})
    batches = pa.concat_tables([table, long]).combine_chunks().to_batches(max_chunksize=137)
    out = pa.Table.from_batches(frequent._heaviest(10)(iter(batches))).to_pylist()
    assert {(r["item"], r["weight"]) for r in out if r["item"]} == {("zz", 6300), *((f"v{n:05d}", n) for n in range(4991, 5000))}
    assert [int(r["range_total"]) for r in out if r["item"] is None] == [ sum(range(5000)) + 6300]
    runs = pa.Table.from_batches(frequent.sorted_runs(iter(batches)))
    assert sum(runs.column("weight").to_pylist()) == sum(range(5000)) + 6300


@given(st.lists(st.sets(st.integers(0, 65535), max_size=40), min_size=1, max_size=6), st.booleans())
@settings(max_examples=40, deadline=None)
def test_containers_round_trip(groups, large):
    groups = [sorted(g) for g in groups]
    if large:
        groups[0] = list(range(0, 60000, 7))
    lows = np.array([x for g in groups for x in g], np.int64)
    starts = np.cumsum([0, *map(len, groups)])[:-1]
    packed = term_counts.pack(lows, starts)
    got, owner = term_counts.unpack(packed)
    assert [sorted(got[owner == i].tolist()) for i in range(len(groups))] == groups
    if large:
        assert len(packed[0].as_py()) == term_counts.BITMAP_BYTES


@pytest.mark.parametrize("size", [4095, 4096, 4097])
def test_containers_about_the_bound_between_array_and_bitmap(size):
    rng = np.random.default_rng(size)
    lows = np.sort(rng.choice(65536, size, replace=False))
    got, owner = term_counts.unpack(term_counts.pack(np.append(lows, [7, 9]), np.array([0, size])))
    assert (got == np.append(lows, [7, 9])).all() and (owner == np.append(np.zeros(size), [1, 1])).all()
    assert (term_counts.unpack(term_counts.pack(lows, np.array([0])))[0] == lows).all()


def test_document_frequency_about_the_bound_on_the_cluster(spark):
    sizes = (4095, 4096, 4097, 65_536)
    rows = spark.createDataFrame([("id", f"t{n}", r, 1, 0) for n in sizes for r in range(n)], TERMS).repartition(5)
    assert {r.term: (r.occurrences, r.records) for r in term_counts.term_counts(rows).collect()} == {f"t{n}": (n, n) for n in sizes}


def test_term_counts_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [("piece", "hot", int(r), 2, 0) for r in rng.integers(-200_000, 200_000, 4000)]
    rows += [("piece", f"t{int(rng.integers(0, 300))}", int(rng.integers(0, 90)), int(rng.integers(0, 5)), 0) for _ in range(4000)]
    rows += [("id", "t1", 5, None, 0), ("id", "", 1 << 40, 3, 0), ("id", None, 1, 1, 0), (None, "a", 1, 1, 0), ("id", "b", None, 1, 0)]
    want = defaultdict(lambda: [0, set()])
    for f, t, r, n, _ in rows:
        if None not in (f, t, r):
            want[f, t][0] += n or 0
            want[f, t][1].add(r)
    got = term_counts.term_counts(spark.createDataFrame(rows, TERMS).repartition(6)).collect()
    assert {(r.field, r.term): (r.occurrences, r.records) for r in got} == {k: (n, len(s)) for k, (n, s) in want.items()}
    assert term_counts.term_counts(spark.createDataFrame([], TERMS)).collect() == []


def test_marks(spark):
    counts = spark.createDataFrame([("p", "a", 3, 9), ("p", "b", 4, 6), ("p", "c", 9, 1)], "field string, term string, occurrences bigint, records bigint")
    totals = spark.createDataFrame([("p", 10)], "field string, n_records bigint")
    got = {r.term: r.marks for r in term_counts.marked(counts, totals, {"p": ("occurrences", 4, 0.6)}).collect()}
    assert got == {"a": ["rare", "common"], "b": [], "c": []}


@pytest.mark.parametrize("mean,cap", [(0.3, 1), (0.9, 2), (1.7, 3), (4.9, 5), (199.5, 400), (250.5, 400), (0.001, 1000), (5000.25, 6000), (5999.5, 6000), (40_000.5, 1 << 30), (0, 3), (3, 3)])
def test_cut_poisson_has_the_mean(mean, cap):
    first, cdf = mixing.copies(mean, cap)
    assert first + len(cdf) <= cap and cdf == sorted(cdf) and len(cdf) < 10_000
    assert math.isclose(first + sum(1 - c for c in cdf), mean, rel_tol=1e-6, abs_tol=1e-9)


@pytest.mark.parametrize("rate,cap", [(0.7, 9), (3.2, 4), (60.0, 80), (900.0, 950)])
def test_poisson_against_the_recurrence(rate, cap):
    log_p, want, total = -rate, [], 0.0
    for k in range(cap):
        total += math.exp(log_p)
        want.append(total)
        log_p += math.log(rate / (k + 1))
    first, cdf = mixing.poisson(rate, cap)
    assert np.allclose(cdf, want[first:], atol=1e-12) and (first == 0 or want[first - 1] < 1e-12)


def test_mixture_shares_caps_and_repeats(spark):
    docs = [(i, "abc"[i % 3] if i % 50 else None, "x" * (i % 40), i) for i in range(3000)]
    docs = spark.createDataFrame(docs, "doc_id bigint, source string, text string, copy_no bigint").withColumn("n_tokens", mixing.byte_tokens(mixing.F.col("text")))
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 3), ("c", 0.45, 1), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    one = {tuple(r) for r in mixing.mixture(docs, targets).select("doc_id", "copy_no", "shuffle_key").collect()}
    two = {tuple(r) for r in mixing.mixture(docs.repartition(7), targets).select("doc_id", "copy_no", "shuffle_key").collect()}
    assert one == two and len({k[:2] for k in one}) == len(one)
    report = {r.source: r for r in mixing.mix_report(docs, targets).collect()}
    assert {s for s, r in report.items() if r.short} == {"c", "none"}
    assert report["a"].most_copies == 1 and report["b"].most_copies <= 3
    assert report["c"].mixed_tokens == report["c"].source_tokens
    assert abs(report["a"].mixed_tokens / (0.2 * report["a"].total_tokens) - 1) < 0.06
    assert abs(report["b"].mixed_tokens / (0.3 * report["b"].total_tokens) - 1) < 0.06
    assert math.isclose(sum(r.actual_share for r in report.values()), 1)
    assert mixing.shuffled(mixing.mixture(docs.limit(0), targets)).collect() == []


def test_two_targets_for_a_source_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a", 3)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(Exception, match="two targets"):
        mixing.mix_plan(docs, targets).collect()
