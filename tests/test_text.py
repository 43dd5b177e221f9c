from pyspark.sql import functions as F

from phraseloom.functions import text as t
from phraseloom.sources import corpus


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression.alias("x")).first()["x"]


def test_tokens_fold_ascii_alone(spark):
    assert one(spark, t.tokenize("s"), s="É_x Hi😀Yo «Привет» e-mail 1.5") == ["É", "x", "hi😀yo", "«Привет»", "e", "mail", "1", "5"]
    assert spark.sql("SELECT CAST(NULL AS STRING) s").select(t.tokenize("s").alias("x")).first()["x"] == []


def test_byte_order_marks(spark):
    for raw, want in ((b"\xff\xfe" + "This doc".encode("utf-16-le") + b"x", ["this", "doc"]), (b"\xfe\xff" + "This doc".encode("utf-16-be"), ["this", "doc"]), (b"\xef\xbb\xbfThis doc", ["﻿this", "doc"])):
        assert one(spark, t.tokenize(t.decode_bytes("b")), b=bytearray(raw)) == want
    assert len(one(spark, t.tokenize(t.decode_bytes("b")), b=bytearray(b"caf\xe9 ok"))) == 2


def test_records():
    assert list(corpus.records('a b\nc,d,e\n"q ""x"" \n y",z\n')) == ["a b", "c d e", 'q "x" \n y z']
    assert list(corpus.records("a\n\n,,\nb")) == ["a", "b"]
    assert list(corpus.records("a\rb\r\nc")) == ["a", "b", "c"]
    assert list(corpus.records("a\tb", corpus.delimiter_of("\\t"))) == ["a b"]
    assert list(corpus.records("")) == []


def test_display_and_score(spark):
    assert one(spark, t.display_phrase("p", "q"), p="a b c d", q="b c") == "a <PARENT> d"
    assert one(spark, t.display_phrase("p", "q"), p="a b", q="z") == "a b"
    assert one(spark, t.normalize_phrase("p"), p="  A\t b ") == "a b"
    assert one(spark, t.sequence_text("p"), p=[0, 1, 0]) == "0 -1 1 -1 0 -1 -2"
    assert one(spark, t.pareto_score(F.lit(4), F.lit(3), F.lit(4), F.lit(3)), z=1) == 0


def test_directory_and_delimited_agree(spark, tmp_path):
    texts = ["a b c f a c e", "x f a c e f l f", "y f l f"]
    (tmp_path / "d" / "sub").mkdir(parents=True)
    for k, x in enumerate(texts):
        (tmp_path / "d" / ("sub" if k else "") / f"f{k}.txt").write_text(x)
    (tmp_path / "d" / "other.md").write_text("not this")
    (tmp_path / "all.csv").write_text("\n".join(texts))
    from_files = corpus.read_corpus(spark, str(tmp_path / "d"), mask="*.txt")
    from_rows = corpus.read_corpus(spark, str(tmp_path / "all.csv"))
    assert sorted(r["text"] for r in from_files.collect()) == sorted(r["text"] for r in from_rows.collect()) == sorted(texts)
    assert [r["source"] for r in from_rows.orderBy("doc_id").collect()] == ["row_0", "row_1", "row_2"]
    assert from_files.count() == 3 and corpus.read_corpus(spark, str(tmp_path / "d")).count() == 4
    assert corpus.read_corpus(spark, str(tmp_path / "all.csv"), sampling=0.7).count() == 2
