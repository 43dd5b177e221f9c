from phraseloom import cli
from phraseloom.operators import grams
from phraseloom.sources.corpus import read_results
from phraseloom.streaming import vocabulary
from tests.texts import COVERED


def test_mine_then_tree(spark, tmp_path, capsys):
    (tmp_path / "c.csv").write_text("\n".join(COVERED))
    cli.main(["mine", str(tmp_path / "c.csv"), "--out", str(tmp_path / "r"), "--n", "2", "--ngrams", "2", "--stats"])
    found = {(r["phrase"], r["freq"], r["example_files"]) for r in read_results(spark, str(tmp_path / "r")).collect()}
    assert found == {("p q r s", 2, "row_0|row_1"), ("u v r s", 2, "row_2|row_3")}
    cli.main(["tree", str(tmp_path / "r"), "--out", str(tmp_path / "t")])
    assert "p q r s" in (tmp_path / "t" / "tree.html").read_text()
    cli.main(["tree", str(tmp_path / "r"), "--out", str(tmp_path / "u"), "--min_l", "99"])
    assert "no results" in capsys.readouterr().out


def test_running_vocabulary_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(["a b a", "b c", None])), "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    vocabulary.start(stream, "vocabulary_test", str(tmp_path / "state")).awaitTermination(120)
    assert {tuple(r) for r in spark.table("vocabulary_test").collect()} == {tuple(r) for r in grams.vocabulary(grams.with_tokens(docs)).collect()}
