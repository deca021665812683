"""Operators on small tables: goldens, rejections, nulls and empty tables, invariance."""

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions.sql import register
from lexmill.kernels.model import Model
from lexmill.kernels.text import valid_piece
from lexmill.operators import continuation as N
from lexmill.operators import corpus as C
from lexmill.operators import evaluation, overlay
from lexmill.operators import segment as S
from lexmill.operators import training as L
from lexmill.operators import vocabulary as V
from lexmill.plans import models as queries
from lexmill.plans.models import program
from lexmill.session import cut, tidied
from lexmill.sources import model_files, rejects
from lexmill.spec import NormalizerSpec, SpecError, TrainerSpec
from lexmill.streaming import streams

PLAIN = NormalizerSpec("identity", add_dummy_prefix=False)
DUMMY = NormalizerSpec("identity")


def normal(model):
    return [p for p, _, t in model.pieces if t == "NORMAL"]


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "text string")


MERGED = [
    (("abracadabra",), 17, (), "ab ra abra ad cad abracad abracadabra ac br a b r c d"),
    (("pen", "pineapple", "apple"), 17, (), "ap le app apple en in ine pen p e a l n i"),
    (("hellohe",), 17, (), "he ll llo hello hellohe el lo oh hel ohe e h l o"),
    (("pen", "pineapple", "apple"), 17, ("app",), "le en in ine pen pine ne pe e l n p i"),
]


@pytest.mark.parametrize("rows,size,symbols,want", MERGED)
def test_merge_goldens(spark, rows, size, symbols, want):
    model, _ = L.train_pairs(texts(spark, *rows), TrainerSpec("bpe", vocab_size=size, character_coverage=1.0, user_defined_symbols=symbols), PLAIN)
    assert " ".join(normal(model)) == want


WEIGHTED = [("magnanimity ", 5), ("Pineapple ", 6), ("i have an apple and a pen ", 1), ("Overly ", 6), ("Available ", 3)]


def test_unigram_golden(spark):
    df = spark.createDataFrame(WEIGHTED, "text string, freq bigint").coalesce(1)
    spec = TrainerSpec("unigram", vocab_size=27, character_coverage=1.0)
    rows = L.covered(L.training_rows(df, spec, PLAIN), spec)[0].withColumn("at", F.monotonically_increasing_id())
    assert len(L.seed_pieces(rows, spec, "at")) == 53
    model = L.train_unigram(df, spec, PLAIN, "at")
    assert " ".join(sorted(normal(model))) == "A Available O Overly P Pineapple a b d e g h i l m magnanimity n p r t v y ▁ ▁an"


def test_word_goldens(spark):
    df = texts(spark, "I have a pen", "I have an apple", "apple pen")
    assert normal(L.train(df, TrainerSpec("word", vocab_size=7), DUMMY)) == ["▁I", "▁apple", "▁have", "▁pen"]
    model = L.train(texts(spark, "hello . world", "hello . test"), TrainerSpec("word", vocab_size=8, hard_vocab_limit=False, user_defined_symbols=(".",)), DUMMY)
    assert [p for p, *_ in model.pieces_of("hello . world")] == ["▁hello", "▁.", "▁world"]


def test_coverage_golden(spark):
    df = texts(spark, "a" * 50 + "あ" * 49 + "b")
    kept = lambda **k: {r.char: r.freq for r in V.alphabet(V.char_histogram(df), 0.98, **k).filter("kept").collect()}
    assert kept() == {"a": 50, "あ": 49}
    assert kept(required="漢字") == {"漢": 0, "字": 0, "a": 50, "あ": 49}


@pytest.mark.parametrize("kind", ["unigram", "bpe", "word", "char"])
def test_weights_equal_repetitions_and_partitions_do_not_matter(spark, kind):
    rows = [("the cat sat on the mat", 3), ("a cat and a hat", 2), ("the hat", 4)]
    spec = TrainerSpec(kind, vocab_size=24, character_coverage=1.0, hard_vocab_limit=False)
    one = L.train(spark.createDataFrame(rows, "text string, freq bigint"), spec, DUMMY)
    two = L.train(texts(spark, *(t for t, n in rows for _ in range(n))).repartition(5), spec, DUMMY)
    assert one.pieces == two.pieces
    df = texts(spark, "the cat", "", None, "zebra")
    counts = {r.id: r.n for r in S.token_counts(df, one).collect()}
    ids = [i for r in df.select(S.encode_ids("text", one).alias("i")).collect() if r.i for i in r.i]
    assert counts == {i: ids.count(i) for i in ids}


@given(st.lists(st.text("ab", min_size=1, max_size=8), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_pair_learner_against_recounting(words):
    spec = TrainerSpec(character_coverage=1.0)
    fast = L.PairLearner([(w, 1 + i) for i, w in enumerate(dict.fromkeys(words))], spec).learn(6)
    rows = [(list(w), 1 + i) for i, w in enumerate(dict.fromkeys(words))]
    seen, done, slow = {}, set(), []
    while len(slow) < 6:
        count = {}
        for s, n in rows:
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + n
        seen |= dict.fromkeys(count)
        options = [(-count.get(p, 0), len(p[0] + p[1]), p[0] + p[1], len(p[0]), p) for p in seen if p not in done]
        if not options:
            break
        pair = min(options)[-1]
        done.add(pair)
        if pair[0] + pair[1] in {a + b for a, b in slow}:
            continue
        slow.append(pair)
        rows = [(L.joined(s, *pair), n) for s, n in rows]
    assert fast == slow


def test_distributed_merges_equal_local_ones(spark):
    df = texts(spark, "banana bandana", "cabana ban", "band aid")
    spec = TrainerSpec("bpe", vocab_size=20, character_coverage=1.0, hard_vocab_limit=False)
    _, local = L.train_pairs(df, spec, DUMMY)
    _, far = L.train_pairs(df, spec, DUMMY, local_words=2)
    assert far == local[: len(far)] and len(far) >= 5


@pytest.mark.parametrize("size", [16, 22, 80])
def test_distributed_merges_keep_seeds_protected_pieces_and_gone_pairs(spark, size):
    df = texts(spark, "banana bandana", "cabana ban", "band aid")
    spec = TrainerSpec("bpe", vocab_size=size, character_coverage=1.0, hard_vocab_limit=False)
    given = {"seed_merges": (("n", "a"), ("d", "a")), "protected": ("an",)}
    model, local = L.train_pairs(df, spec, DUMMY, **given)
    other, far = L.train_pairs(df, spec, DUMMY, local_words=2, **given)
    assert far == local and far[:2] == [("n", "a"), ("d", "a")] and ("a", "n") not in far
    assert other.pieces == model.pieces


def test_automatic_coverage_counts_all_words_when_distributed(spark):
    df = texts(spark, "漢é漢é banana", "bandana é", "cabana 漢字", "band aid")
    spec = TrainerSpec("bpe", vocab_size=256 + 3 + 12, character_coverage=1.0, hard_vocab_limit=False, byte_fallback=True, auto_character_coverage=True)
    model, local = L.train_pairs(df, spec, DUMMY)
    other, far = L.train_pairs(df, spec, DUMMY, local_words=1)
    assert far == local and other.pieces == model.pieces


def test_automatic_coverage():
    assert L.best_mixture([10, 5, 1], [("漢", 4), ("é", 3), ("a", 99)], 3) == (2, ["漢"])
    assert L.best_mixture([], [("漢", 4)], 3) == (0, ["漢"])


def test_repeated_substrings_against_brute_force(spark):
    lines = ["▁the▁morphology▁of▁morphologists", "▁morphologists▁12▁the", "▁données▁là▁où", "▁données▁12▁x", "▁the▁morphology▁of▁morphologists"]
    spec = TrainerSpec("unigram")
    count, following = {}, {}
    for t in lines:
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + spec.max_piece_length) + 1):
                count[t[i:j]] = count.get(t[i:j], 0) + 1
                following.setdefault(t[i:j], set()).add((t[j : j + 1] or "\0").encode()[:1])
    want = {p: n for p, n in count.items() if n > 1 and len(following[p]) > 1 and len(p) > 1 and valid_piece(p, spec)}
    got = L.repeated_substrings(texts(spark, *lines).withColumn("freq", F.lit(1).cast("bigint")), spec)
    assert {r.piece: r.n for r in got.collect()} == want and max(map(len, want)) > 6


@pytest.mark.parametrize("batch", [3, 10_000])
def test_substrings_by_windows_are_those_counted_one_by_one(spark, batch):
    import random

    rng = random.Random(batch)
    rows = [("".join(rng.choices("abé漢😀\0", [9, 9, 3, 3, 3, 1], k=rng.choice((1, 2, 5, 30)))), rng.randint(1, 3)) for _ in range(150)]
    rows.append(("".join(rng.choices("abc", k=2 * L.BLOCK + 7)), 2))  # cut into blocks
    count, following = {}, {}
    for t, f in rows:
        for i in range(len(t)):
            for j in range(i + 2, min(len(t), i + 5) + 1):
                count[t[i:j]] = count.get(t[i:j], 0) + f
                following.setdefault(t[i:j], set()).add((t[j : j + 1] or "\0").encode()[0])
    want = {p: n for p, n in count.items() if n >= 3 and "\0" not in p}
    df = spark.createDataFrame([(t, f, "\0") for t, f in rows], "text string, freq bigint, end string").repartition(3)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert {r.piece: r.n for r in L.prefix_counts(df, 5, 3).collect()} == want
        assert {r.piece: r.n for r in L.prefix_counts(df, 5, 3, True).collect()} == {p: n for p, n in want.items() if len(following[p]) > 1}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pieces_are_judged_after_they_are_counted(spark):
    """Else Python gets a row, with its text, for every place where a piece stands."""
    rows = spark.createDataFrame([("▁abc", 3), ("▁abd", 2)], "text string, freq bigint")
    frames = [N.candidates(rows, spark.createDataFrame([("ab",)], "piece string")), L.repeated_substrings(rows, TrainerSpec()), L.valid_pairs(L.pair_counts(L.symbols_of(rows.withColumnRenamed("text", "word"))), TrainerSpec())]
    for df in frames:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.index("ArrowEvalPython") < plan.index("Aggregate"), plan


def test_candidates_without_a_bound_are_all(spark):
    rows = spark.createDataFrame([("abcabc", 1), ("xyxy", 5)], "text string, freq bigint")
    none = spark.createDataFrame([], "piece string")
    got = {r.piece: r.n for r in N.candidates(rows, none, most=None).collect()}
    assert got == {"ab": 2, "bc": 2, "abc": 2, "xy": 10, "yx": 5, "xyx": 5, "yxy": 5, "xyxy": 5}
    assert [r.piece for r in N.candidates(rows, none, most=2).collect()] == ["xyxy", "xy"]


def test_unigram_queries_meet_a_corpus_with_the_trainers_own_options(spark):
    d = "/root/testdata/sf0.001"
    seeds = {r.piece for r in queries.QUERIES["seed_substrings_lines"](spark, d).collect()}
    pieces = {r.piece for r in queries.QUERIES["train_unigram"](spark, d).collect()}
    assert len(pieces) > 1000 and max(map(len, seeds)) > 6 and max(map(len, pieces)) > 6


def test_a_soft_limit_keeps_all_characters_and_a_hard_one_refuses(spark):
    df = spark.createDataFrame([("abcdefgh abc abd", 2), ("hgfe dcba", 1)], "text string, freq bigint")
    spec = dict(vocab_size=8, character_coverage=1.0)
    model = L.train_unigram(df, TrainerSpec("unigram", hard_vocab_limit=False, **spec), DUMMY)
    assert {p for p, _, t in model.pieces if t == "NORMAL"} == set("abcdefgh▁")
    rows = spark.createDataFrame([("▁abc▁hgfe", 1)], "text string, freq bigint")
    assert len(N.refit(rows, model, 2)[1]) == 2
    with pytest.raises(SpecError, match="too small"):
        L.train_unigram(df, TrainerSpec("unigram", **spec), DUMMY)


def test_sparse_training(spark):
    df = spark.createDataFrame(WEIGHTED, "text string, freq bigint")
    model = L.train_unigram(df, TrainerSpec("unigram", vocab_size=30, character_coverage=1.0, hard_vocab_limit=False, sparse_pruning=True), DUMMY)
    assert 20 <= len(model.pieces) <= 30


def test_corpus_edges(spark):
    df = texts(spark, "a\n\nb", None, "", "x▅", "y" * 5000)
    assert sorted(r.text for r in C.lines(df).collect()) == ["", "", "a", "b", "x▅", "y" * 5000]
    assert {r.reason: r.n for r in C.filter_report(df).collect()} == {"kept": 1, "empty": 2, "reserved": 1, "too long": 1}
    lines = spark.createDataFrame([("a b\t3",), ("c\t1",)], "value string")
    assert sorted(map(tuple, C.parsed_weights(lines).collect())) == [("a b", 3), ("c", 1)]
    for bad in ("a", "a\t0", "a\tx", "a\t1\tm"):
        with pytest.raises(Exception, match="not a weighted line"):
            C.parsed_weights(spark.createDataFrame([(bad,)], "value string")).collect()
    with pytest.raises(Exception, match="weight below"):
        C.weighted(spark.createDataFrame([("a", 0)], "text string, freq bigint")).collect()
    meta = spark.createDataFrame([(" a ", 2, "m"), ("a", 3, "m"), ("a", 1, None), ("  ", 1, "m")], "text string, freq bigint, meta string")
    assert sorted(map(tuple, C.prepared(meta, PLAIN).collect())) == [("a", "", 1), ("a", "m", 5)]
    big = spark.createDataFrame([("a", 2**62), ("a", 2**62)], "text string, freq bigint")
    with pytest.raises(Exception, match="overflow"):
        C.prepared(big, PLAIN).collect()
    split = texts(spark, "▁ab▁c")
    assert C.pretokenized(split, F.split("text", "(?=▁)")).first()[0] == "\x1f▁ab\x1f▁c" or C.pretokenized(split, F.split("text", "(?=▁)")).first()[0] == "▁ab\x1f▁c"
    with pytest.raises(Exception, match="differs"):
        C.pretokenized(split, F.array(F.lit("no"))).collect()
    assert C.sample(texts(spark, *map(str, range(50))), 9).collect() == C.sample(texts(spark, *map(str, range(50))).repartition(7), 9).collect()
    assert C.delimited(texts(spark, "a|b"), "|").first()[0] == "a\x1fb"


def test_text_columns_with_nulls(spark):
    df = spark.createDataFrame([("é  x",), (None,), ("",)], "text string")
    got = df.select(X.normalize_column("text").alias("n"), X.aligned_column("text").alias("a"), X.script_column("text").alias("s"), X.valid_piece_column("text").alias("v")).collect()
    assert [r.n for r in got] == ["▁é▁x", None, ""] and got[1].a is None and [r.s for r in got] == ["Latin", None, None] and [r.v for r in got] == [False, False, False]
    raw = spark.createDataFrame([(b"a\xe3\x81",), (b"ok",), (None,)], "raw binary")
    assert [r[0] for r in raw.select(X.decode_column("raw")).collect()] == ["a��", "ok", None]
    off = spark.createDataFrame([("aé漢", [0, 1, 3, 6])], "t string, o array<int>")
    assert off.select(X.char_offsets_column(F.col("t"), F.col("o"))).first()[0] == [0, 1, 2, 3]
    assert texts(spark, "a.b\\Ec").select(X.replace_all_column("text", [".b", "\\E"], "$1")).first()[0] == "a$1$1c"


END = (("<unk>", 0.0, "UNKNOWN"), ("<s>", 0.0, "CONTROL"), ("</s>", 0.0, "CONTROL"), ("a", 0.0, "NORMAL"), ("b", 0.3, "NORMAL"), ("c", 0.2, "NORMAL"), ("ab", 1.0, "NORMAL"), ("▁", 3.0, "NORMAL"))


def test_segment_columns(spark):
    m = Model(END, TrainerSpec("unigram"), DUMMY)
    df = spark.createDataFrame([(1, "ab c"), (2, None), (3, ""), (4, "zz ab"), (5, "ab " * 30_000)], "id int, text string")
    got = {r.id: r for r in df.select("id", S.encode_ids("text", m, "bos:eos").alias("i"), S.encode_pieces("text", m).alias("p"), S.encode_spans("text", m).alias("s"), S.encode_nbest("text", m, 2).alias("n"), S.sample_ids("text", m, 0.5, 1).alias("d")).collect()}
    assert got[1].i == [1, 7, 6, 7, 5, 2] and got[2].i is None and got[3].i == [1, 2] and got[4].p == ["▁", "zz", "▁", "ab"]
    assert "".join(s.surface for s in got[4].s) == "zz ab" and got[2].d is None and got[1].n[0] == [7, 6, 7, 5] and len(got[5].i) == 60_002
    back = df.select("id", S.decode_ids(S.encode_ids("text", m), m).alias("t"), S.decode_pieces(S.encode_pieces("text", m), m).alias("p"))
    assert {r.id: r.p for r in back.collect() if r.id != 5} == {1: "ab c", 2: None, 3: "", 4: "zz ab"}
    with pytest.raises(ValueError):
        S.encode_nbest("text", Model(END, TrainerSpec("char")), 2)
    with pytest.raises(ValueError):
        S.sample_ids("text", Model(END, TrainerSpec("word")), 1.0)
    report = evaluation.evaluate(df.filter("id < 4"), m).first()
    assert (report.sentences, report.bytes, report.tokens) == (1, 5, 4)
    none = evaluation.evaluate(df.limit(0), m).first()
    assert (none.bytes, none.tokens, none.nats_per_byte) == (0, 0, 0.0)


def test_vocabulary_tables(spark):
    m = Model(END, TrainerSpec("unigram"), DUMMY)
    vocab = V.vocabulary(spark, m)
    assert V.model_pieces(vocab)[3][0] == "a" and V.vocabulary_faults(vocab).collect() == []
    bad = vocab.unionByName(spark.createDataFrame([(8, "a", float("nan"), "NORMAL"), (20, None, 0.0, None)], "piece_id int, piece string, score float, type string"))
    assert {r.fault for r in V.vocabulary_faults(bad).collect()} == {"piece twice", "score not finite", "empty piece", "unknown type", "ids not dense"}
    assert {r.piece: r.id for r in V.piece_ids(spark.createDataFrame([("ab",), ("zz",), (None,)], "piece string"), vocab).collect()} == {"ab": 6, "zz": 0, None: 0}
    assert [r.piece for r in V.id_pieces(spark.createDataFrame([(6,), (99,)], "id int"), vocab).orderBy("id").collect()] == ["ab", None]
    with pytest.raises(ValueError):
        V.exported(vocab, "nothing")


def test_overlay_columns(spark):
    df = spark.createDataFrame([(1, [1, 38, 1, 2, 3, 5, 5, 39]), (2, None), (3, [])], "id int, ids array<int>")
    got = {r.id: r for r in df.select("id", overlay.overlay_encode("ids", program()).alias("e"), overlay.overlay_stats("ids", program()).alias("s"), overlay.overlay_expand(overlay.overlay_encode("ids", program()), program()).alias("x")).collect()}
    assert got[1].e == [1, 38, 42, 43, 39] and got[1].x == [1, 38, 1, 2, 3, 5, 5, 39] and got[2].e is None and got[3].e == [] and got[1].s.merges == 3
    rules = spark.createDataFrame([(0, 1, 2, 40, [1, 2])], "rank int, left_id int, right_id int, child_id int, base_expansion array<int>")
    assert overlay.overlay_of(rules, 40, 48, 38, 39).encode([38, 1, 2, 39]) == [38, 40, 39]


def test_model_files(spark, tmp_path):
    m = Model(END, TrainerSpec("unigram", control_symbols=("x",)), NormalizerSpec("own", (("A", "a"),)))
    model_files.save(spark, m, str(tmp_path / "m"))
    again = model_files.load(spark, str(tmp_path / "m"))
    assert [p[0] for p in again.pieces] == [p[0] for p in m.pieces] and again.trainer == m.trainer and again.normalizer == m.normalizer
    model_files.write_lines(V.vocabulary(spark, m), str(tmp_path / "v"), "syms")
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()][6] == "ab\t6"
    model_files.write_merges(spark, [("a", "b"), ("ab", "c")], str(tmp_path / "g"))
    assert [(r.left, r.right) for r in model_files.read_merges(spark, str(tmp_path / "g")).orderBy("rank").collect()] == [("a", "b"), ("ab", "c")]
    (tmp_path / "seeds.txt").write_text("ab\t3\nbroken\nabc\tx\ncde\t9\n")
    assert [tuple(r) for r in model_files.read_seeds(spark, str(tmp_path / "seeds.txt")).collect()] == [("cde", 27), ("ab", 6)]
    (tmp_path / "symbols.txt").write_text("one\n\ntwo\n")
    assert model_files.read_symbols(spark, str(tmp_path / "symbols.txt")) == ["one", "two"]
    with pytest.raises(SpecError):
        model_files.load(spark, "")


def test_streams_and_sql(spark, tmp_path):
    m = Model(END, TrainerSpec("unigram"), DUMMY)
    spark.createDataFrame([("ab c", "2026-01-01 00:10:00"), (None, "2026-01-01 00:20:00"), ("c c", "2026-01-01 03:00:00")], "text string, at string").select("text", F.col("at").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "rows"))
    rows = streams.read_rows(spark, str(tmp_path / "rows"), "text string, at timestamp")
    assert sorted((r.text or "", r.ids) for r in streams.drain(streams.encoded_stream(rows, m), "one").collect()) == [("", None), ("ab c", [7, 6, 7, 5]), ("c c", [7, 5, 7, 5])]
    assert {(r.word, r.freq) for r in streams.drain(streams.running_words(rows), "two", "complete").collect()} == {("▁ab", 1), ("▁c", 3)}
    by_hour = streams.drain(streams.word_counts(rows, "at"), "three", "update").collect()
    assert {(r.word, r.freq) for r in by_hour} == {("▁ab", 1), ("▁c", 1), ("▁c", 2)}
    register(spark, m, "t")
    texts(spark, "ab c", None).createOrReplaceTempView("some")
    assert [tuple(r) for r in spark.sql("select t_count(text), t_decode(t_encode(text)), t_normalize(text) from some order by text nulls last").collect()] == [(4, "ab c", "▁ab▁c"), (None, None, None)]
    assert [tuple(r) for r in spark.sql("select * from t_tokenize('ab')").collect()] == [(0, "▁", 7, 0, 0), (1, "ab", 6, 0, 2)]


def test_a_drained_stream_lies_in_files_and_keeps_the_last_update_of_a_key(spark, tmp_path):
    for n, text in enumerate(("a b", "a a", "c")):
        spark.createDataFrame([(text, "2026-01-01 00:10:00")], "text string, at string").select("text", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    rows = streams.read_rows(spark, str(tmp_path / "rows"), "text string, at timestamp", files_at_once=1)
    last = streams.drain(streams.word_counts(rows, "at"), "updates", "update", ("window", "word"))
    assert sorted((r.word, r.freq) for r in last.collect()) == [("▁a", 3), ("▁b", 1), ("▁c", 1)] and last.columns == ["window", "word", "freq"]
    assert len(streams.drain(streams.word_counts(rows, "at"), "all_updates", "update").collect()) == 4
    assert sorted((r.word, r.freq) for r in streams.drain(streams.running_words(rows), "whole", "complete").collect()) == [("▁a", 3), ("▁b", 1), ("▁c", 1)]
    # Rows that the driver held would stand in the plan itself.
    assert "LocalTableScan" not in last._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(streams.STORE[0]) != streams.STORE[1]
    (tmp_path / "none").mkdir()
    assert streams.drain(streams.encoded_stream(streams.read_rows(spark, str(tmp_path / "none"), "text string"), Model(END, TrainerSpec("unigram"), DUMMY)), "empty").collect() == []


def test_encoded_rows_of_a_stream_stay_off_the_driver(spark, tmp_path):
    texts(spark, *(f"ab c{n}" for n in range(50))).write.parquet(str(tmp_path / "rows"))
    stream = streams.encoded_stream(streams.read_rows(spark, str(tmp_path / "rows"), "text string"), Model(END, TrainerSpec("unigram"), DUMMY))
    out = streams.drain(stream, "encoded_files")
    assert out.count() == 50 and "FileScan" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fallback", [False, True])
def test_ids_of_words_are_taken_without_building_their_pieces(monkeypatch, fallback):
    pieces = [("<unk>", 0.0, "UNKNOWN"), ("▁", -2.0, "NORMAL"), ("a", -1.5, "NORMAL"), ("▁a", -1.0, "NORMAL"), ("ab", -2.5, "NORMAL")]
    model = Model((*pieces, *((f"<0x{n:02X}>", 0.0, "BYTE") for n in range(256) if fallback)), TrainerSpec("unigram", byte_fallback=fallback), DUMMY).checked()
    rng = random.Random(2)
    rows = ["".join(rng.choice("abxé漢😀 ") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["x" * 99, "", None]
    want = [None if t is None else model.encode(t) for t in rows]

    def refuse(*_):
        raise AssertionError("pieces were built")

    monkeypatch.setattr(Model, "finished", refuse)
    assert S.BatchEncoder(model)(S.pa.array(rows)).to_pylist() == want


def test_merges_over_stretches_are_those_over_words(spark):
    lines = ["abc漢字abc 12ab3 漢字漢字 e\u0301te\u0301 \u0301ab", "漢字abcかな 漢字 e\u0301te\u0301x ababab aaaa", "abcabc漢漢漢 12 12ab"]
    for spec in (TrainerSpec("bpe"), TrainerSpec("bpe", split_by_number=False), TrainerSpec("bpe", whitespace_as_suffix=True), TrainerSpec("bpe", split_digits=True)):
        words = L.words_of(spark.createDataFrame([("▁" + x.replace(" ", "▁"), n + 1) for n, x in enumerate(lines)], "text string, freq bigint"), spec)
        parts = L.segments_of(words, spec)
        want = L.PairLearner([(r.word, r.freq) for r in words.collect()], spec).learn(60)
        assert len(want) > 5 and L.PairLearner(L.gathered(parts), spec).learn(60) == want
        assert L.merge_gains(want, L.gathered(parts)) == L.merge_gains(want, L.gathered(words)) == L.merge_gains_distributed(want, words)
    assert {r.word for r in L.segments_of(spark.createDataFrame([("▁abc漢字12x", 1)], "word string, freq bigint"), TrainerSpec("bpe")).collect()} == {"▁abc", "漢字", "12"}


def test_merges_on_the_driver_are_held_in_arrays():
    import tracemalloc

    import random

    rng = random.Random(1)
    words = [("▁" + "".join(rng.choices("abcdefghij", k=12)), 1) for _ in range(20_000)]
    tracemalloc.start()
    try:
        assert len(L.PairLearner(words, TrainerSpec("bpe")).learn(50)) == 50
        assert tracemalloc.get_traced_memory()[1] < 150 * 20_000 * 12 / 2  # bytes; with sets of words it is several times that
    finally:
        tracemalloc.stop()


def test_a_worker_holds_the_kernel_of_one_step():
    one = L.newest("one", lambda: L.Trainable(["a"], [-1.0]))
    assert L.newest("one", lambda: None) is one
    L.newest("two", lambda: L.Trainable(["b"], [-1.0]))
    assert list(L._newest) == ["two"]


def test_continued_merges(spark):
    rows = spark.createDataFrame([("▁abab", 5), ("▁abc", 4), ("▁aaa", 3)], "text string, freq bigint")
    alphabet = (N.Piece(0, "<unk>", "UNKNOWN", False), *(N.Piece(i, c, "NORMAL", True, True) for i, c in enumerate("▁abc", 1)))
    base = N.Program(alphabet, ())
    one = N.continue_pairs(rows, base, 2)
    two = N.continue_pairs(rows, one, 2)
    whole = N.continue_pairs(rows, base, 4)
    assert [p.id for p in two.pieces] == list(range(9)) and two.pieces[:7] == one.pieces and two.merges == whole.merges and two.identity() == whole.identity()
    counted = {(r.left, r.right): r.n for r in N.support_counts(L.symbols_of(rows.withColumnRenamed("text", "word"))).collect()}
    assert counted["a", "a"] == 3 and counted["a", "b"] == 14
    with pytest.raises(SpecError, match="could be learnt"):
        N.continue_pairs(rows, base, 500)


@pytest.mark.parametrize("pieces,merges", [
    ([N.Piece(0, "a", "NORMAL", True, True), N.Piece(0, "b", "NORMAL", True, True)], []), ([N.Piece(0, "a", "NORMAL", False, True)], []), ([N.Piece(0, "a", "NORMAL", True, False)], []),
    ([N.Piece(0, "x", "USER_DEFINED", True, False)], []), ([N.Piece(0, "a", "NORMAL", True, True), N.Piece(1, "aa")], []), ([N.Piece(0, "a", "NORMAL", True, True)], [("a", "a")]),
    ([N.Piece(0, "a", "NORMAL", True, True), N.Piece(1, "aa")], [("a", "a"), ("a", "a")]), ([N.Piece(0, "a", "NORMAL", True, True), N.Piece(1, "ab")], [("a", "b")]),
])
def test_programs_that_are_rejected(pieces, merges):
    with pytest.raises(SpecError):
        N.Program(tuple(pieces), tuple(merges)).checked()


def test_unigram_continuation_and_refit(spark):
    rows = spark.createDataFrame([("▁the▁cat", 9), ("▁the▁zebra", 4)], "text string, freq bigint")
    prior = Model((("<unk>", 0.0, "UNKNOWN"), *((c, -2.5, "NORMAL") for c in "▁thecabr"), ("th", -2.0, "NORMAL")), TrainerSpec("unigram"), DUMMY)
    model, gauge = N.continue_unigram(rows, prior, 4, hard_limit=False)
    assert len(model.pieces) == len(prior.pieces) + 4 and "z" in normal(model)
    assert N.prefix_faults(V.vocabulary(spark, prior), V.vocabulary(spark, model), gauge).collect() == []
    assert model.unk not in model.encode("the zebra")
    again, history = N.refit(rows, model, 5)
    assert [p for p, _, _ in again.pieces] == [p for p, _, _ in model.pieces] and all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    with pytest.raises(Exception, match="no segmentation"):
        N.refit(spark.createDataFrame([("▁q", 1)], "text string, freq bigint"), model, 1)
    with pytest.raises(SpecError):
        N.bisect("f", lambda x: 1.0 + x * x, -1, 1)
    assert abs(N.bisect("f", lambda x: x**3 - 8, -1, 1) - 2) < 1e-9


def test_candidates_and_ambiguity(spark):
    rows = spark.createDataFrame([("▁abc", 3), ("▁abd", 2)], "text string, freq bigint")
    got = {r.piece: r.n for r in N.candidates(rows, spark.createDataFrame([("ab",)], "piece string")).collect()}
    assert got == {"▁a": 5, "▁ab": 5, "▁abc": 3, "▁abd": 2, "abc": 3, "abd": 2, "bc": 3, "bd": 2}
    vocab = spark.createDataFrame([(i, p, 0.0, "NORMAL") for i, p in enumerate(("a", "b", "c", "ab", "bc", "abc", "zz"))], "piece_id int, piece string, score float, type string")
    assert {r.piece: r.splits for r in N.ambiguous_pieces(vocab).collect()} == {"abc": 2, "zz": 0}


LINES = ['"a\tb""c"\t1\tm', '"abc"x"\t3\tt', '"abc""\t5\tt', 'Th"e\t4\tlog', 'a\t"12\tlog', "only", "", "x\t1\tm\tz", '"multi\nline"\t2\tm', 'x\t1\t""', '"x" \t1\tm', "\t1\tm", 'a\t1\t"x"\t"y"', "nl\nin\t1\tm",
         '"a"\t"2"\t"c"', "a\r\t1\tm", "x\t0\tm", "x\t007\tm", "x\t9223372036854775808\tm", "x\t9223372036854775807\t", "x\t９\tm", "x\t+1\tm", " 　\t1\tm", "x\t1\t\t", None, "1\t1\tm"]
REASONS = [None, "quoting", "quoting", None, "quoting", "columns", "columns", "columns", None, None, "quoting", "invalid_value", "columns", None, None, None, "invalid_value", None, "invalid_value", None, "invalid_value", "invalid_value", "invalid_value", "columns", "columns", None]


def test_lines_with_reasons(spark):
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(LINES)], "raw_id bigint, raw_line string, reason int")
    got = {r.raw_id: r for r in rejects.load_lines(df).collect()}
    assert [got[i].reason for i in range(len(LINES))] == REASONS
    assert (got[0].text, got[0].weight, got[0].meta) == ('a\tb"c', 1, "m") and got[8].text == "multi\nline" and got[13].text == "nl\nin" and got[15].text == "a\r" and got[17].weight == 7 and got[25].text == "1"
    assert rejects.load_lines(df.limit(0)).collect() == []


def test_lines_against_the_exact_scan(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice('""\t\tab1 \né\r') for _ in range(rng.randint(0, 14)))) for i in range(3000)] + [(9999, '"' + "word " * 60_000 + '"\t1\tm')]
    got = {r.raw_id: r.reason for r in rejects.load_lines(spark.createDataFrame(rows, "raw_id bigint, raw_line string")).collect()}
    for i, line in rows:
        fields, wrong = rejects.scan(line)
        valid = len(fields) == 3 and fields[0].strip() and rejects.WEIGHT.fullmatch(fields[1]) and rejects.in_range(fields[1])
        assert got[i] == ("quoting" if wrong else "columns" if len(fields) != 3 else None if valid else "invalid_value")


def test_reasons_come_from_the_joined_reject_rows(tmp_path):
    import duckdb

    lines = ["only", "x\t1\tm\tz", "x\tabc\tm", "x\t5\tm", '"abc"x"\t3\tt', "x\t99999999999999999999\t"]
    read = rejects._read(duckdb.connect(), str(tmp_path), lines)
    kinds = ["MISSING COLUMNS", "TOO MANY COLUMNS", "CAST", None, "UNQUOTED VALUE", "CAST"]
    assert [read.errors.get(i, (None,))[0] for i in range(len(lines))] == kinds
    got = [rejects.judged(x, read.rows.get(i), read.errors.get(i)) for i, x in enumerate(lines)]
    assert [r[3] for r in got] == ["columns", "columns", "invalid_value", None, "quoting", "invalid_value"]
    assert "weight" in got[2][4] and "byte 2" in got[2][4]
    for i in (0, 1, 2, 5):  # without the reject rows there is no reason
        with pytest.raises(ValueError, match="neither a row nor an error"):
            rejects.judged(lines[i], read.rows.get(i), None)


def random_rows(spark, seed, n=500):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé文") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    return spark.createDataFrame([(" ".join(rng.choice(stems) + rng.choice(stems) for _ in range(6)), rng.randint(1, 9)) for _ in range(n)], "text string, freq bigint")


@pytest.mark.parametrize("window", [3, 512])
def test_many_merges_a_pass_are_learnt_in_the_order_of_one_at_a_time(spark, monkeypatch, window):
    monkeypatch.setattr(L, "WINDOW", window)
    words = L.words_of(C.normalized(random_rows(spark, 5), DUMMY), TrainerSpec("bpe"))
    spec = TrainerSpec("bpe", split_by_script=False)
    local = L.PairLearner([(r.word, r.freq) for r in words.collect()], spec).learn(60)
    jobs = []
    monkeypatch.setattr(L, "all_applied", lambda s, m, f=L.all_applied: jobs.append(len(m)) or f(s, m))
    assert L.learn_distributed(words, spec, 60) == local
    assert sum(jobs) == 60 and len(jobs) < 60


def test_continuations_on_the_cluster_learn_the_same(spark):
    rows = C.normalized(random_rows(spark, 8, 200), DUMMY)
    base = N.Program((N.Piece(0, "<unk>", "UNKNOWN", False), *(N.Piece(1 + i, c, "NORMAL", True, True) for i, c in enumerate("abcde▁"))), ())
    near, far = (N.continue_pairs(rows, base, 25, local_words=n) for n in (1 << 20, 1))
    assert near == far and len(near.merges) == 25
    again = [N.continue_pairs(rows, near, 8, local_words=n).merges for n in (1 << 20, 1)]
    assert again[0] == again[1]


def test_merge_files_keep_order_and_levels(spark, tmp_path):
    merges = [("b", "c"), ("a", "bc", 2), ("▁", "abc")] + [(f"x{i}", "y") for i in range(300)]
    model_files.write_merges(spark, merges, str(tmp_path / "m"))
    got = model_files.read_merges(spark, str(tmp_path / "m")).orderBy("rank").collect()
    assert [(r.left, r.right) if r.level is None else (r.left, r.right, r.level) for r in got] == merges and [r.rank for r in got] == list(range(303))


def test_scripts_of_all_planes_and_unknown_pieces():
    from lexmill.kernels import text as T

    assert [T.script(c) for c in "aжα中あーไ𑀅𞤀𐤀ᯀ1"] == ["Latin", "Cyrillic", "Greek", "Han", "Han", "Han", "Thai", "Brahmi", "Adlam", "Phoenician", "Batak", "Common"]
    model = Model((("<unk>", 0.0, "UNKNOWN"), ("<s>", 0.0, "CONTROL"), ("</s>", 0.0, "CONTROL"), ("▁", -1.0, "NORMAL"), ("a", -1.0, "NORMAL")), TrainerSpec("unigram"), NormalizerSpec("identity"))
    found = [(p, i) for p, i, *_ in model.pieces_of("aqa")]
    assert model.piece_options("")(found) == ["▁", "a", "q", "a"]
    assert model.piece_options("unk:bos:reverse")(found) == ["a", "<unk>", "a", "▁", "<s>"]


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("form", [NormalizerSpec("identity"), NormalizerSpec("nmt_nfkc"), NormalizerSpec("identity", add_dummy_prefix=False, remove_extra_whitespaces=False)])
def test_long_texts_in_parts_are_encoded_like_whole_ones(spark, fallback, form):
    rng = random.Random(4)
    pieces = [("<unk>", 0.0, "UNKNOWN"), ("▁", -2.0, "NORMAL"), ("a", -1.5, "NORMAL"), ("▁a", -1.0, "NORMAL"), ("ab", -2.5, "NORMAL")]
    model = Model((*pieces, *((f"<0x{n:02X}>", 0.0, "BYTE") for n in range(256) if fallback)), TrainerSpec("unigram", byte_fallback=fallback), form).checked()
    rows = [(i, "".join(rng.choice("abx  q") for _ in range(rng.randint(0, 90)))) for i in range(40)] + [(90, None), (91, ""), (92, "x" * 50), (93, "   ")]
    df = spark.createDataFrame(rows, "id int, text string")
    want = {r.id: r.ids for r in df.select("id", S.encode_ids("text", model).alias("ids")).collect()}
    assert {r.id: r.ids for r in S.encode_long(df, model, "id", chunk=7).collect()} == want


def continued(spark, new=14, **more):
    rows = C.normalized(random_rows(spark, 3, 120), DUMMY)
    prior = Model((("<unk>", 0.0, "UNKNOWN"), *((c, -1.9 - n / 10, "NORMAL") for n, c in enumerate("▁abcde")), ("ab", -3.0, "NORMAL"), ("q", 0.0, "UNUSED")), TrainerSpec("unigram"), DUMMY)
    model, gauge = N.continue_unigram(rows, prior, new, TrainerSpec("unigram", split_by_script=False), hard_limit=False, **more)
    return rows, prior, model, gauge


def test_unigram_continuation_is_stationary_and_keeps_the_mass(spark):
    rows, prior, model, gauge = continued(spark)
    assert len(model.pieces) == len(prior.pieces) + 14 and {"é", "文"} <= {p for p, _, _ in model.pieces[len(prior.pieces) :]}
    assert N.prefix_faults(V.vocabulary(spark, prior), V.vocabulary(spark, model), gauge).collect() == []
    own = [(p, s) for p, s, t in prior.pieces if t == "NORMAL"]
    scores, lengths = N.np.array([s for _, s in own]), N.np.array([len(p) for p, _ in own], float)
    assert abs(sum(N.math.exp(s) for _, s, t in model.pieces if t == "NORMAL") - 1) < 1e-9
    # The gauge is the best one for the counts that it was made from: no gauge near it does better.
    at = lambda g: 700.0 * g + 90.0 * N.math.log(1 - N.math.exp(N.base_mass(scores, lengths, g)))
    best = N.stationary_gauge(scores, lengths, 700.0, 90.0)
    assert at(best) >= max(at(best - 1e-3), at(best + 1e-3))
    assert N.base_mass(scores, lengths, N.stationary_gauge(scores, lengths, 5.0, 0.0)) == pytest.approx(0, abs=1e-9)
    assert N.base_mass(scores, lengths, N.stationary_gauge(scores, lengths, 0.0, 5.0)) == pytest.approx(N.NO_MASS, abs=1e-6)


def test_unigram_continuation_sends_stretches_and_leaves_no_shuffle_files(spark, monkeypatch):
    sent = []
    take = N.candidates
    monkeypatch.setattr(N, "candidates", lambda view, *a: sent.extend((r.text, r.freq) for r in view.collect()) or take(view, *a))
    rows = spark.createDataFrame([("▁abc漢字12x", 2), ("▁abcd漢字", 3)], "text string, freq bigint")
    prior = Model((("<unk>", 0.0, "UNKNOWN"), *((c, -4.0, "NORMAL") for c in "▁abcd漢字12x")), TrainerSpec("unigram"), DUMMY)
    model, _ = N.continue_unigram(rows, prior, 3, hard_limit=False)
    assert sorted(sent) == [("12", 2), ("▁abc", 2), ("▁abcd", 3), ("漢字", 5)]
    assert "漢字" in normal(model)
    dirs = [Path(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in dirs for p in d.rglob("shuffle_*.data")}
    before = files()
    with tidied(spark):
        assert len(cut(rows.groupBy("text").agg(F.sum("freq").alias("freq"))).collect()) == 2
    assert not files() - before
    rows.groupBy("text").agg(F.sum("freq").alias("freq")).collect()
    assert files() - before


def test_unigram_continuation_fences_and_faults(spark):
    _, prior, model, _ = continued(spark, fences=("cd",))
    assert not [p for p, _, _ in model.pieces[len(prior.pieces) :] if "cd" in p]
    with pytest.raises(SpecError, match="need pieces"):
        continued(spark, 1)
    full = Model((("<unk>", 0.0, "UNKNOWN"), ("▁", -0.1, "NORMAL"), ("a", -0.1, "NORMAL")), TrainerSpec("unigram"), DUMMY)
    with pytest.raises(SpecError, match="no mass"):
        N.continue_unigram(C.normalized(random_rows(spark, 3, 9), DUMMY), full, 20)
    assert N.continue_unigram(spark.createDataFrame([("▁a", 1)], "text string, freq bigint"), full, 0) == (full, 0.0)
