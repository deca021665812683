"""Kernels without Spark, against literal expectations and slow independent versions."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.kernels import merges as M
from lexmill.kernels import text as T
from lexmill.kernels.model import Model, assemble, special_layout
from lexmill.kernels.unigram import UnigramKernel, digamma
from lexmill.sources import model_files
from lexmill.spec import NormalizerSpec, SpecError, TrainerSpec

PAIRS = [("   ＡＢＣ   ", "▁ABC"), ("①②③", "▁123"), ("㍿", "▁株式会社"), (" ｸﾞｰｸﾞﾙ ", "▁グーグル"), (" A  B  C ", "▁A▁B▁C"), ("   ", ""), ("\x7f\x10", ""), ("", "")]


@pytest.mark.parametrize("raw,norm", PAIRS)
def test_normal_forms(raw, norm):
    own = T.Normalizer()
    assert own(raw) == norm
    text, origin = own.aligned(raw)
    assert text == norm and len(origin) == len(norm.encode()) + 1 and origin == sorted(origin)


def test_blank_options():
    make = lambda **k: T.Normalizer(NormalizerSpec("identity", **k))
    assert make(add_dummy_prefix=False)(" a  b ") == "a▁b"
    assert make(suffix=True)(" a  b ") == "a▁b▁"
    assert make(remove_extra_whitespaces=False)(" a  b ") == "▁▁a▁▁b▁"
    assert make(escape_whitespaces=False)("a b") == " a b"


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_alignment_agrees_with_the_form(text):
    for spec in (NormalizerSpec(), NormalizerSpec("identity", remove_extra_whitespaces=False), NormalizerSpec("nfc", add_dummy_prefix=False)):
        own = T.Normalizer(spec)
        norm, origin = own.aligned(text)
        assert norm == own(text)
        assert origin == sorted(origin) and origin[-1] <= len(text.encode("utf-8", "surrogatepass"))


def test_rules():
    rules = T.read_rules(["41 302 300\t1EA6", "U+61\t62 63\t# a => bc", "7A"])
    assert rules == {"A\u0302\u0300": "\u1ea6", "a": "bc", "z": ""}
    own = T.Normalizer(NormalizerSpec("own", tuple(rules.items()), add_dummy_prefix=False))
    assert own("A\u0302\u0300az!") == "\u1ea6bc!"
    assert T.read_rules(T.write_rules(rules)) == rules
    for bad in ({"": "a"}, {"a": "a"}):
        with pytest.raises(SpecError):
            T.checked_rules(bad)
    assert T.without_redundant({"a": "b", "c": "d", "ac": "bd", "ca": "x"}) == {"a": "b", "c": "d", "ca": "x"}
    assert T.Normalizer(NormalizerSpec("nmt_nfkc_cf"))("ＡßΣ") == "▁aßσ"
    small = dict(itertools.islice(sorted(T.named_rules("nfkc").items()), 400)) | {"e\u0301": "\u00e9"}
    assert model_files.read_rule_blob(model_files.write_rule_blob(small)) == small


def test_utf8_and_matching():
    assert T.decode(b"a\xe3\x81b\xff") == "a��b�"
    assert not T.is_valid(b"\xed\xa0\x80") and T.is_valid("é".encode())
    assert T.to_char_offsets("aé漢", [0, 1, 2, 3, 6]) == [0, 1, 1, 2, 3]
    own = T.PrefixMatcher(["ab", "abc", "x"])
    assert own.prefix("abcd") == ("abc", True) and own.prefix("zab") == ("z", False)
    assert own.replace("abcab-x", "#") == "##-#"
    assert T.csv_fields('a,"b ""c"", d",') == ["a", 'b "c", d', ""]


def test_words_and_shapes():
    assert T.split_words("▁a▁bc▁") == ["▁a", "▁bc", "▁"]
    assert T.split_words("a▁bc▁", suffix=True) == ["a▁", "bc▁"]
    assert T.split_words("▁▁a▁b", whitespace_only=True) == ["▁▁a", "▁b"]
    assert T.split_words("▁a▁1▁b", interval=True) == ["▁a", "▁1▁b"]
    good = TrainerSpec()
    assert [p for p in ("▁ab", "a▁b", "a1", "漢ひカー", "aж", "", "▁", "１２", "a b", "a" * 17) if T.valid_piece(p, good)] == ["▁ab", "漢ひカー", "▁", "１２"]
    assert T.valid_piece("a1", TrainerSpec(split_by_number=False)) and not T.valid_piece("12", TrainerSpec(split_digits=True))
    assert T.valid_piece("a▁b", TrainerSpec(split_by_whitespace=False)) and T.valid_piece("ab▁", TrainerSpec(whitespace_as_suffix=True))


VOCAB = [("<unk>", 0.0, "UNKNOWN"), ("<s>", 0.0, "CONTROL"), ("</s>", 0.0, "CONTROL"), ("ab", 0.0, "NORMAL"), ("cd", -0.1, "NORMAL"), ("abc", -0.2, "NORMAL"), ("a", -0.3, "NORMAL"),
         ("b", -0.4, "NORMAL"), ("c", -0.5, "NORMAL"), ("ABC", 0.0, "USER_DEFINED"), ("abcdabcd", 0.0, "USER_DEFINED"), ("q", 0.0, "USER_DEFINED"), ("r", 0.0, "USER_DEFINED"), ("qr", -0.5, "NORMAL")]
SPLITS = ["ab cd", "abc c", "x abc ab a ab cd d", "x y z 東 京", "ab ABC cd", "ab abcdabcd cd", "ab q r cd"]


@pytest.mark.parametrize("want", SPLITS)
@pytest.mark.parametrize("kind", [UnigramKernel, M.PairKernel])
def test_segmenting(kind, want):
    text = want.replace(" ", "")
    found = kind(VOCAB).best(text)
    path = found[0] if kind is UnigramKernel else found
    assert " ".join(text[a:b] for a, b, _ in path) == want


def all_splits(text, pieces):
    if not text:
        yield ()
    for k in range(1, len(text) + 1):
        if text[:k] in pieces:
            for rest in all_splits(text[k:], pieces):
                yield (text[:k], *rest)


def test_unigram_against_enumeration():
    rng = random.Random(5)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "bca", "aa"]
    for _ in range(40):
        scores = {n: -rng.random() * 5 for n in names}
        own = UnigramKernel([("<unk>", 0.0, "UNKNOWN"), *((n, s, "NORMAL") for n, s in scores.items())])
        text = "".join(rng.choice("abc") for _ in range(7))
        ranked = sorted((-sum(scores[p] for p in s), s) for s in all_splits(text, scores))
        path, score = own.best(text)
        assert math.isclose(score, -ranked[0][0])
        best = own.nbest(text, 8)
        assert [round(s, 9) for _, s in best] == [round(-s, 9) for s, _ in ranked[:8]]
        counts = {}
        total = own.expected(text, 2.0, counts)
        z = math.log(sum(math.exp(-s) for s, _ in ranked))
        assert math.isclose(total, 2 * z)
        for i, n in enumerate(names, 1):
            assert math.isclose(counts.get(i, 0.0), 2 * sum(math.exp(-s - z) * t.count(n) for s, t in ranked), abs_tol=1e-9)
        draw = random.Random(1)
        drawn = [own.sample(text, 1.0, draw) for _ in range(50)]
        assert all("".join(text[a:b] for a, b, _ in p) == text for p in drawn)
    assert math.isclose(digamma(1.0), -0.5772156649015329, abs_tol=1e-7)


def test_unreachable_and_samples():
    own = UnigramKernel([("<unk>", 0.0, "UNKNOWN"), *((p, s, "NORMAL") for p, s in (("a", -1), ("b", -2), ("ab", -4), ("c", -1), ("d", -1), ("cd", -1.5)))])
    assert [own.pieces[i][0] for i in own.unreachable()] == ["ab"]
    rng = random.Random(2)
    assert own.sample_nbest("cd", 0, 1.0, rng) == own.best("cd")[0]
    assert len(own.distinct_samples("abcd", 4, 0.5, rng)) == 4
    every = {tuple((e.begin, e.end, e.id) for e in p): s for p, s in own.paths("abcd")}
    whole = own.distinct_samples("abcd", 1000, 0.5, rng)
    assert len(whole) == len(every) == len({tuple(p) for p, _ in whole}) and all(math.isclose(every[tuple(p)], s) for p, s in whole)
    first = [tuple(own.distinct_samples("abcd", 2, 0.7, rng)[0][0]) for _ in range(6000)]
    total = sum(math.exp(0.7 * s) for s in every.values())
    assert all(abs(first.count(p) / 6000 - math.exp(0.7 * s) / total) < 0.03 for p, s in every.items())
    shares = [own.sample_nbest("cd", 2, 0.0, rng) for _ in range(400)]
    assert 120 < sum(len(p) == 1 for p in shares) < 280


def test_dropout_and_unused():
    pieces = [*VOCAB[:3], ("a", -1.0, "NORMAL"), ("b", -2.0, "NORMAL"), ("ab", 0.0, "UNUSED"), ("abb", 1.0, "NORMAL")]
    own = M.PairKernel(pieces)
    assert [own.best("ab")[k][2] for k in range(2)] == [3, 4] and own.best("abb")[0][2] == 6
    rng = random.Random(1)
    assert len(M.PairKernel(VOCAB).best("abcd", 1.0, rng)) == 4
    assert {len(M.PairKernel(VOCAB).best("abcd", 0.5, rng)) for _ in range(60)} >= {2, 3, 4}


PROGRAM = [(0, 1, 1, 12, (1, 1)), (1, 2, 3, 13, (2, 3)), (2, 1, 2, 14, (1, 2))]


def slow_overlay(ids):
    rank = {(a, b): (r, c) for r, a, b, c, _ in PROGRAM}
    out, block = [], None
    for x in ids:
        if x == 8:
            block = []
            out.append(x)
        elif x == 9:
            while True:
                options = [(rank[p][0], i) for i, p in enumerate(zip(block, block[1:])) if p in rank]
                if not options:
                    break
                _, i = min(options)
                block[i : i + 2] = [rank[block[i], block[i + 1]][1]]
            out += [*block, x]
            block = None
        elif block is None:
            out.append(x)
        else:
            block.append(x)
    return out


def test_overlay_against_a_slow_one():
    own = M.Overlay(12, 16, 8, 9, PROGRAM, frozenset({7}))
    rng = random.Random(348)
    for _ in range(300):
        ids = [1, 2, 3]
        for _ in range(3):
            ids += [8, *(rng.choice([1, 2, 3]) for _ in range(rng.randint(0, 40))), 9, 7]
        assert own.encode(ids) == slow_overlay(ids)
        for dropout in (0.0, 0.4, 1.0):
            coded = own.encode(ids, dropout, 5)
            assert own.expand(coded) == ids and coded == own.encode(ids, dropout, 5)
    stats = {}
    own.encode([8, 1, 1, 2, 3, 9], stats=stats)
    assert stats["merges"] == 2


@pytest.mark.parametrize("ids,message", [([9], "wasn't open"), ([8, 8], "inside"), ([8, 1], "isn't closed"), ([12], "outside"), ([99], "range"), ([8, 15, 9], "unknown")])
def test_overlay_errors(ids, message):
    with pytest.raises(SpecError, match=message):
        M.Overlay(12, 16, 8, 9, PROGRAM).encode(ids)


@pytest.mark.parametrize("rules", [[(0, 1, 14, 12, (1, 2))], [(0, 1, 2, 11, (1, 2))], [(0, 1, 2, 12, (2, 1))], [(0, 7, 2, 12, (7, 2))], [(0, 1, 2, 12, (1, 2)), (0, 2, 1, 13, (2, 1))], [(0, 1, 2, 12, (1, 2)), (1, 1, 2, 13, (1, 2))]])
def test_overlay_rejects_programs(rules):
    with pytest.raises(SpecError):
        M.Overlay(12, 16, 8, 9, rules, frozenset({7}))


def test_ranked_program_differs_from_scores():
    pieces = [(0, "<unk>", "UNKNOWN", False), (1, "a", "NORMAL", True), (2, "b", "NORMAL", True), (3, "c", "NORMAL", True), (4, "ab", "NORMAL", False), (5, "bc", "NORMAL", False), (6, "abc", "NORMAL", False)]
    own = M.RankedProgram(pieces, [(0, "b", "c", "bc"), (1, "a", "b", "ab"), (2, "ab", "c", "abc")])
    assert [i for _, _, i in own.encode("abc")] == [1, 5]
    assert [i for _, _, i in own.encode("abxbc")] == [4, 0, 5]
    with pytest.raises(SpecError):
        M.atoms("aab", {"a": 1, "aa": 2, "ab": 3, "b": 4}, 2)


def test_special_layout_and_assembly():
    spec = TrainerSpec("bpe", vocab_size=8, control_symbols=("<c>",), user_defined_symbols=("app", "<s>"))
    assert special_layout(spec) == {0: ("<unk>", "UNKNOWN"), 1: ("<s>", "USER_DEFINED"), 2: ("</s>", "CONTROL"), 3: ("<c>", "CONTROL"), 4: ("app", "USER_DEFINED")}
    for bad in ({"control_symbols": ("x", "x")}, {"user_defined_symbols": ("<unk>",)}, {"bos_id": 0}):
        with pytest.raises(SpecError):
            special_layout(TrainerSpec(**bad))
    with pytest.raises(SpecError, match="too large"):
        assemble(spec, [("a", 0.0)])
    assert len(assemble(TrainerSpec("bpe", vocab_size=8, hard_vocab_limit=False), [("a", 0.0)]).pieces) == 4
    assert len(special_layout(TrainerSpec(byte_fallback=True))) == 259


@pytest.mark.parametrize("values", [{"vocab_size": 0}, {"character_coverage": 0.5}, {"max_piece_length": 0}, {"num_sub_iterations": 11}, {"shrinking_factor": 0.99}, {"input_sentence_size": 50}, {"model_type": "x"}, {"use_all_vocab": True}, {"unk_piece": ""}])
def test_options_out_of_range(values):
    with pytest.raises(SpecError):
        TrainerSpec(**values).validated()


@pytest.mark.parametrize("pieces", [[("a", 0.0, "NORMAL")], [("<unk>", 0.0, "UNKNOWN"), ("a", 0.0, "NORMAL"), ("a", 0.0, "NORMAL")], [("<unk>", 0.0, "UNKNOWN"), ("", 0.0, "NORMAL")], [("<unk>", 0.0, "UNKNOWN"), ("<0x00>", 0.0, "BYTE")]])
def test_vocabularies_that_do_not_load(pieces):
    with pytest.raises(SpecError):
        Model(tuple(pieces)).checked()


END = (("<unk>", 0.0, "UNKNOWN"), ("<s>", 0.0, "CONTROL"), ("</s>", 0.0, "CONTROL"), ("a", 0.0, "NORMAL"), ("b", 0.3, "NORMAL"), ("c", 0.2, "NORMAL"), ("ab", 1.0, "NORMAL"), ("▁", 3.0, "NORMAL"))


def test_model_end_to_end():
    m = Model(END, TrainerSpec("unigram"), NormalizerSpec("identity"))
    assert m.encode("ab c") == [7, 6, 7, 5] and m.decode([7, 6, 7, 5]) == "ab c"
    assert m.encode("axyb") == [7, 3, 0, 4] and m.decode([7, 0, 4]) == " ⁇ b"
    assert m.options("bos:eos:reverse")([3]) == [2, 3, 1] and m.special("<s>") == 1 and m.special("a") == -1
    spans = m.spans(" ab  c")
    assert [(s.piece, s.begin, s.end) for s in spans] == [("▁", 1, 1), ("ab", 1, 3), ("▁", 3, 5), ("c", 5, 6)]
    assert [(s.surface, s.begin, s.end) for s in m.decode_spans([7, 6, 7, 5])] == [("", 0, 0), ("ab", 0, 2), (" ", 2, 3), ("c", 3, 4)]
    with pytest.raises(SpecError):
        m.decode([99])
    with pytest.raises(SpecError):
        m.options("nothing")
    assert m.nbest("ab", 2)[0] == m.encode("ab") and m.sample("abc", 0.5, 3) == m.sample("abc", 0.5, 3)
    for kind in ("char", "word"):
        with pytest.raises(SpecError):
            Model(END, TrainerSpec(kind)).nbest("a", 2)
    assert model_files.from_wire(model_files.to_wire(m)).encode("ab c") == [7, 6, 7, 5]
    with pytest.raises(SpecError):
        model_files.from_wire(b"\xff\xff")


def test_byte_fallback_and_words():
    rows = (*END, *((f"<0x{n:02X}>", 0.0, "BYTE") for n in range(256)))
    m = Model(rows, TrainerSpec("unigram", byte_fallback=True), NormalizerSpec("identity"))
    assert [p for p, *_ in m.pieces_of("é")] == ["▁", "<0xC3>", "<0xA9>"]
    assert m.decode(m.encode("aéb漢")) == "aéb漢"
    assert m.decode([8 + 0xE3, 8 + 0x81]) == "��"
    plain = Model(END, TrainerSpec("unigram"), NormalizerSpec("identity"))
    assert plain.by_words
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("abcxy  ") for _ in range(20))
        assert plain.encode_words(text, {}) == plain.encode(text)


BATCH_TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab c▁é中 \n"), max_size=14)), max_size=12)


@given(BATCH_TEXTS, st.booleans(), st.sampled_from(["identity", "nmt_nfkc", "kept", "no_prefix"]), st.sampled_from(["unigram", "bpe"]))
@settings(max_examples=250, deadline=None)
def test_batches_are_encoded_like_single_texts(texts, fallback, form, kind):
    import pyarrow as pa

    from lexmill.operators.segment import BatchEncoder

    spec = {"kept": NormalizerSpec("identity", remove_extra_whitespaces=False), "no_prefix": NormalizerSpec("identity", add_dummy_prefix=False)}.get(form) or NormalizerSpec(form)
    pieces = [("<unk>", 0.0, "UNKNOWN"), ("▁", -2.0, "NORMAL"), ("a", -1.5, "NORMAL"), ("b", -3.0, "NORMAL"), ("▁a", -1.0, "NORMAL"), ("ab", -2.5, "NORMAL"), ("▁ab", -2.6, "NORMAL"), ("c", -4.0, "NORMAL")]
    pieces += [(f"<0x{n:02X}>", 0.0, "BYTE") for n in range(256)] if fallback else []
    model = Model(tuple(pieces), TrainerSpec(kind, byte_fallback=fallback), spec).checked()
    assert model.by_words
    own = BatchEncoder(model)
    got = own(pa.array(["x", *texts, "y"], pa.string()).slice(1, len(texts))).to_pylist()
    assert got == [None if t is None else model.encode(t) for t in texts]


@given(st.text(st.sampled_from("abcd"), max_size=14), st.integers(0, 1000))
@settings(max_examples=150, deadline=None)
def test_best_path_and_ties_against_all_paths(text, seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)})
    pieces = [("<unk>", 0.0, "UNKNOWN")] + [(w, -float(rng.randint(1, 4)), "USER_DEFINED" if rng.random() < 0.1 else "NORMAL") for w in words]
    kernel = UnigramKernel(pieces)
    # Forward over beginnings: of equal paths to a place the one from the first beginning stays.
    n, ids = len(text), {p: (i, s, t) for i, (p, s, t) in enumerate(pieces)}
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for i in range(n):
        for k in range(1, n - i + 1):
            hit = ids.get(text[i : i + k])
            s = None if hit is None else 0.1 * (k - 1) if hit[2] == "USER_DEFINED" else hit[1]
            if s is None and k == 1:
                s = kernel.unknown_score
            if s is not None and score[i] + s > score[i + k]:
                score[i + k], back[i + k] = score[i] + s, i
    want, at = [], n
    while at:
        want.append((back[at], at))
        at = back[at]
    path, best = kernel.best(text)
    assert [p[:2] for p in path] == want[::-1] and best == score[n]


@given(st.text(st.sampled_from("abc"), max_size=40), st.integers(0, 1000))
@settings(max_examples=150, deadline=None)
def test_short_words_merge_like_long_ones(text, seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(30)})
    kernel = M.PairKernel([("<unk>", 0.0, "UNKNOWN")] + [(w, -float(rng.randint(1, 9)), "NORMAL") for w in words])
    short = kernel.best(text)
    kept, M.SHORT = M.SHORT, -1
    try:
        assert kernel.best(text) == short
    finally:
        M.SHORT = kept


@pytest.mark.parametrize("x,want", [(0.1, -10.423754940411076), (0.5, -1.9635100260214235), (1.0, -0.5772156649015329), (2.5, 0.7031566406452432), (10.0, 2.251752589066721)])
def test_digamma_against_known_values(x, want):
    assert math.isclose(digamma(x), want, rel_tol=1e-12)
    assert math.isclose(digamma(x + 1), digamma(x) + 1 / x, rel_tol=1e-10, abs_tol=1e-12)
    assert math.isclose(digamma(2 * x), (digamma(x) + digamma(x + 0.5)) / 2 + math.log(2), rel_tol=1e-10, abs_tol=1e-12)


@pytest.mark.parametrize("known_only", [False, True])
def test_training_kernel_is_the_segmenting_one(known_only):

    from lexmill.kernels.unigram import Trainable, UnigramKernel

    rng = random.Random(5)
    names = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(200)} | {"a", "b", "c", "d"})
    if not known_only:
        names.remove("d")  # stands for what is unknown
    scores = [-rng.uniform(1, 12) for _ in names]
    slow = UnigramKernel([*((p, s, "NORMAL") for p, s in zip(names, scores)), ("<unk>", 0.0, "UNKNOWN")])
    fast = Trainable(names, scores)
    for size in (1, 2, 7, 40, 900):  # the last is below what products of probabilities hold
        text = "".join(rng.choices("abcd", k=size))
        want, got = {}, {}
        assert fast.expected(text, 3.0, got, known_only) == pytest.approx(slow.expected(text, 3.0, want, known_only))
        assert got == pytest.approx({i: n for i, n in want.items() if i in got}) and sum(n for i, n in want.items() if i not in got) < 1e-9
        assert fast.best(text) == [i for _, _, i in slow.best(text)[0]]
