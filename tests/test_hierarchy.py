"""Fences, hierarchies, continuation on records and its artifacts."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from lexmill.kernels.hierarchy import Gate, Record, ScopedProgram, checked_gates, fence_policy, fenced, parsed_gates, segmented
from lexmill.kernels.merges import RankedProgram
from lexmill.operators import continuation as N
from lexmill.operators import hierarchy as H
from lexmill.operators import training as L
from lexmill.spec import NormalizerSpec, SpecError, TrainerSpec

LOOSE = TrainerSpec("bpe", split_by_whitespace=False, split_by_script=False, split_by_number=False)
AB = N.Program((N.Piece(0, "<unk>", "UNKNOWN", False), N.Piece(1, "a", "NORMAL", True, True), N.Piece(2, "b", "NORMAL", True, True)), ())
ROWS = "text string, meta string, freq bigint"


def written(tmp_path, *lines):
    path = tmp_path / f"h{random.random()}.tsv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_support_and_applications_are_apart(spark, tmp_path):
    # What this corpus must give.
    corpus = spark.createDataFrame([("aa", "A", 2), ("aa", "B", 3), ("bb", "C", 4)], ROWS)
    sidecar = H.read_sidecar(spark, written(tmp_path, "# any-bpe-hierarchy-v2", "aa\tA\t\t0-2", "", "# a comment", "aa\tB\t\t", "bb\tC\t\t0-2"))
    got = H.continue_records(H.with_hierarchy(corpus, sidecar), AB, 2, LOOSE)
    assert got.counts == (("b", "b", 4, 4), ("a", "a", 2, 5)) and got.tokens == 9
    H.save_learnt(spark, got, AB, str(tmp_path / "out"), NormalizerSpec("identity"))
    again, about = H.load_program(spark, str(tmp_path / "out"))
    assert again == got.program and about["tokens"] == 9 and about["base"] == AB.identity()
    assert H.piece_lines(got)[-2:] == ["bb\t-0\t3", "aa\t-1\t4"]


def test_equal_texts_with_other_metadata_keep_their_order(spark):
    rows = [("aa", str(i), i, "", "0-2") for i in range(10, 42)] + [("bb", "Z", 4, "", "0-2")]
    got = H.continue_records(spark.createDataFrame(rows, ROWS + ", gates string, ranges string").repartition(7), AB, 2, LOOSE)
    canonical = "".join(f"2:{t}\t{n}\t1\t2:{t}\n" for t, _, n, *_ in rows)
    assert got.segmentation == hashlib.sha256(canonical.encode()).hexdigest()


@pytest.mark.parametrize("lines,message", [
    (("no header", "aa\t"), "version"), (("# x-bpe-hierarchy-v2", "aa\tA\t"), "not a line"), (("# x-bpe-hierarchy-v2", "aa\t\t\t"), "not a line"), (("# x-bpe-hierarchy-v2", "aa\tA\t\t"), "no line for a row"),
    (("# x-bpe-hierarchy-v2", "aa\tA\t\t", "bb\tB\t\t", "cc\tC\t\t"), "line for no row"), (("# x-bpe-hierarchy-v2", "aa\tA\t\t", "aa\tA\t\t", "bb\tB\t\t"), "two lines"),
])
def test_sidecars_must_fit_the_corpus(spark, tmp_path, lines, message):
    corpus = spark.createDataFrame([("aa", "A", 1), ("bb", "B", 1)], ROWS)
    with pytest.raises((SpecError, PySparkException), match=message):
        H.with_hierarchy(corpus, H.read_sidecar(spark, written(tmp_path, *lines))).collect()


@pytest.mark.parametrize("text,gates,ranges,message", [
    ("abc", "1:0,2", None, "two children"), ("abc", "0:0,1,2", None, "level"), ("abc", "1:0,2,1", None, "increase"), ("abc", "1:0,1,9", None, "behind"), ("éa", "1:0,1,3", None, "UTF-8"), ("abcd", "1:0,1,2;2:0,1,4", None, "same boundary"),
    ("abcdef", "1:0,1,4;1:2,5,6", None, "overlap"), ("abcdef", "1:0,3,6;2:1,2,5", None, "crosses"), ("abc", "x", None, "colon"), ("abc", "", "2-1", "range"), ("abc", "", "0-2,1-3", "order"), ("éé", "", "1-4", "UTF-8"), ("abc", "1:0,a,3", None, "invalid cut"),
])
def test_broken_gates_and_ranges(text, gates, ranges, message):
    with pytest.raises(SpecError, match=message):
        Record.of(text, gates, ranges)


def test_spans_that_a_hierarchy_supports():
    own = Record.of("abcdef", "2:0,2,4,6;1:2,3,4", None)
    assert [own.supports(*s) for s in ((0, 1), (0, 2), (1, 3), (2, 4), (0, 4), (2, 6), (0, 6), (3, 5), (1, 2), (2, 3))] == [True, True, False, True, True, True, True, False, True, True]
    ranged = Record.of("abcdef", "", "0-2,3-6")
    assert [ranged.supports(*s) for s in ((0, 2), (1, 3), (3, 6), (2, 3))] == [True, False, True, False] and not Record.of("ab", "", "").supports(0, 2)


@given(st.text("ab", max_size=14), st.sets(st.text("ab", min_size=1, max_size=3), max_size=3))
@settings(max_examples=200, deadline=None)
def test_fenced_stretches_are_all_occurrences(text, fences):
    covered = set()
    for i in range(len(text)):
        size = max((len(f) for f in fences if text.startswith(f, i)), default=0)
        covered.update(range(i, i + size))
    found = fenced(text, fences)
    assert {k for a, b in found for k in range(a, b)} == covered and all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_fences_part_merges(spark):
    assert fence_policy(["▁PL:", "a b", "PL"]) == "bpe_explicit_fences_v1:[PL,a%20b,%E2%96%81PL%3A]"
    assert H.normalised_fences(["PL:"], NormalizerSpec("identity")) == ["▁PL:"]
    rows = spark.createDataFrame([("aaabb", 5), ("abab", 1)], "text string, freq bigint")
    got = H.continue_records(rows, AB, 3, LOOSE, fences=("ab",), hard_limit=False)
    assert [c[:3] for c in got.counts] == [("a", "b", 7), ("a", "a", 5)] and got.policy.endswith("[ab]")
    runtime = AB.runtime()
    assert segmented("aabb", runtime, ["ab"]) == ["a", "\x1f", "a", "b", "\x1f", "b"]
    with pytest.raises(SpecError, match="no split"):
        segmented("axb", runtime)
    wide = RankedProgram([(0, "<unk>", "UNKNOWN", False), (1, "aa", "NORMAL", True)], [])
    with pytest.raises(SpecError, match="inside"):
        segmented("aaaa", wide, ["a"][:0], cuts=[1])
    assert [r[0] for r in rows.select(N.unfenced_stretches("text", ["ab"])).collect()] == [["aa", "b"], []]


def test_continuing_records_equals_continuing_words_without_limits(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([("".join(rng.choice("ab") for _ in range(rng.randint(1, 12))), rng.randint(1, 5)) for _ in range(60)], "text string, freq bigint").groupBy("text").sum("freq").toDF("text", "freq")
    one = H.continue_records(rows, AB, 6, LOOSE)
    assert one.program == N.continue_pairs(rows, AB, 6, LOOSE)
    two = H.continue_records(rows, one.program, 3, LOOSE)
    assert two.program.merges == H.continue_records(rows, AB, 9, LOOSE).program.merges


PIECES = [(0, "<unk>", "UNKNOWN", False), *((i, c, "NORMAL", True) for i, c in enumerate("abcd", 1)), (5, "ab", "NORMAL", False), (6, "cd", "NORMAL", False), (7, "abcd", "NORMAL", False), (8, "bc", "NORMAL", False)]
SCOPED = [(0, "a", "b", "ab", None), (1, "c", "d", "cd", 1), (2, "ab", "cd", "abcd", 2), (3, "b", "c", "bc", 0)]


def test_scoped_rules_complete_children():
    own = ScopedProgram(PIECES, SCOPED)
    ids = lambda text, gates: [i for _, _, i in own.encode(text, parsed_gates(gates))]
    assert ids("abcd", "1:2,3,4;2:0,2,4") == [7]
    assert ids("abcd", "2:0,2,4") == [5, 3, 4]
    assert ids("abcd", "") == [5, 3, 4]
    assert ids("abcd", "1:0,1,4") == [5, 3, 4]  # an inherited token crosses the parent, which is left out
    with pytest.raises(SpecError, match="gates"):
        own.encode("abcd", None)
    fresh = ScopedProgram([*PIECES[:5], (5, "bc", "NORMAL", True)], [])
    assert fresh.encode("ad", None) == [(0, 1, 1), (1, 2, 4)]
    with pytest.raises(SpecError, match="two children"):
        own.encode("abcd", [Gate(1, (0, 2))])
    assert checked_gates([], "") == ()


def test_expansions_on_columns(spark):
    program = N.Program(tuple(N.Piece(i, p, t, t == "NORMAL", a) for i, p, t, a in PIECES[:8]), (("a", "b"), ("c", "d"), ("ab", "cd")))
    rows = spark.createDataFrame([("abcd", "1:2,3,4;2:0,2,4"), ("abcd", None), (None, None), ("", None)], "text string, gates string")
    levels = {("c", "d"): 1, ("ab", "cd"): 2}
    assert [r[0] for r in rows.select(H.encode_expansion("text", program, "gates", levels)).collect()] == [[7], [5, 3, 4], None, []]
    assert [r[0] for r in rows.select(H.encode_expansion("text", program)).collect()] == [[7], [7], None, []]
    with pytest.raises(SpecError):
        H.encode_expansion("text", program, None, levels)


def test_normal_forms_are_inherited():
    base = NormalizerSpec("nfc", add_dummy_prefix=False)
    assert H.reconciled(base, NormalizerSpec()) == base and H.reconciled(base, NormalizerSpec("nfc", add_dummy_prefix=False)) == base and H.reconciled(None, base) == base
    with pytest.raises(SpecError, match="normal form"):
        H.reconciled(base, NormalizerSpec("nfc"))


def test_empty_corpus_learns_nothing(spark):
    got = H.continue_records(spark.createDataFrame([], "text string, freq bigint"), AB, 2, LOOSE, hard_limit=False)
    assert got.counts == () and got.tokens == 0 and got.program == AB and got.segmentation == hashlib.sha256(b"").hexdigest()
    assert L.ranked([]) == {}
