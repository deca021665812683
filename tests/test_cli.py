import pytest

from lexmill import cli


def test_commands(spark, tmp_path, capsys):
    text = tmp_path / "in.txt"
    text.write_text("the cat sat\na cat and a hat\nthe hat\n")
    path = lambda name: str(tmp_path / name)
    run = lambda *argv: cli.main(list(argv), spark)
    run("train", "--input", str(text), "--output", path("m"), "--set", "model_type=unigram", "vocab_size=30", "character_coverage=1.0", "hard_vocab_limit=false")
    run("encode", "--model", path("m"), "--input", str(text), "--output", path("ids"), "--format", "id")
    run("decode", "--model", path("m"), "--input", path("ids"), "--show", "9", "--format", "id")
    assert sorted(capsys.readouterr().out.splitlines()) == sorted(text.read_text().splitlines())
    run("encode", "--model", path("m"), "--input", str(text), "--output", path("pieces"))
    run("decode", "--model", path("m"), "--input", path("pieces"), "--show", "9")
    assert sorted(capsys.readouterr().out.splitlines()) == sorted(text.read_text().splitlines())
    for form in ("nbest_id", "sample_id", "sample_piece", "spans"):
        run("encode", "--model", path("m"), "--input", str(text), "--show", "3", "--format", form, "--size", "2")
        assert len(capsys.readouterr().out.splitlines()) == 3
    run("export", "--model", path("m"), "--format", "syms", "--show", "2")
    assert capsys.readouterr().out == "<unk>\t0\n<s>\t1\n"
    run("evaluate", "--model", path("m"), "--input", str(text))
    assert "bytes\t36" in capsys.readouterr().out
    run("refit", "--model", path("m"), "--input", str(text), "--output", path("r"))
    assert len(capsys.readouterr().out.splitlines()) == 8
    (tmp_path / "rules.tsv").write_text("63 61 74\t64 6F 67\n")
    run("normalize", "--input", str(text), "--rules", path("rules.tsv"), "--show", "1")
    assert capsys.readouterr().out == "▁the▁dog▁sat\n"
    for form, n in (("proto", 3), ("nbest_piece", 6), ("nbest_proto", 6), ("sample_proto", 3)):
        run("encode", "--model", path("m"), "--input", str(text), "--show", "9", "--format", form, "--size", "2")
        assert len(capsys.readouterr().out.splitlines()) == n
    run("encode", "--model", path("m"), "--input", str(text), "--show", "1", "--format", "vocabulary")
    assert capsys.readouterr().out.split("\t")[1].strip().isdigit()
    run("charsmap", "--rules", path("rules.tsv"), "--show", "2")
    assert capsys.readouterr().out == "63 61 74\t64 6F 67\t# cat => dog\n"
    plain = ("--normalizer", "name=identity")
    run("continue", "--input", str(text), "--output", path("p1"), "--size", "4", *plain)
    run("continue", "--input", str(text), "--model", path("p1"), "--output", path("p2"), "--size", "2", "--fences", "cat")
    run("expand", "--model", path("p2"), "--input", str(text), "--show", "3")
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 3 and max(int(i) for x in lines for i in x.split()) >= 10
    with pytest.raises(SystemExit):
        run("train", "--input", str(text), "--set", "nothing=1")
