"""A synthetic corpus of unique words with planted sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, LENGTH = 26, 8
_SPACE = LETTERS**LENGTH


def unique_word(number: Column, seed: int = 0) -> Column:
    """The eight-letter word of a number: a step through all such words that no two numbers below 26^8 share."""
    # an odd multiplier that 13 doesn't divide has no factor in common with 26^8
    spread = F.pmod(number * F.lit(48271) + F.lit(seed), F.lit(_SPACE))
    letters = [F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.floor(spread / LETTERS**k) % LETTERS + 1).cast("int"), F.lit(1)) for k in range(LENGTH)]
    return F.concat(*letters)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, count) of a headerless file; a missing or bad count is 1."""
    raw = spark.read.schema("sentence string, count string").option("escape", '"').csv(path)
    return raw.select("sentence", F.coalesce(F.expr("try_cast(count AS INT)"), F.lit(1)).alias("count"))


def synthetic_corpus(spark: SparkSession, n_docs: int, words_per_doc: int, rules: list[tuple[str, int]], seed: int = 0) -> DataFrame:
    """(doc_id, source, text): each sentence once, at a place by chance, in min(count, n_docs) distinct documents.

    Everything follows from the seed. Planted places are few (the sum of counts); the documents are made where they are used.
    """
    docs = spark.range(n_docs).withColumnRenamed("id", "doc_id")
    # the documents of a rule: a stride through all of them, so they differ and nothing is drawn and thrown away
    planted = [(s, (seed + 7919 * (k + 1) + j * max(1, n_docs // max(1, c))) % n_docs, k) for k, (s, c) in enumerate(rules) for j in range(min(c, n_docs))]
    plan = spark.createDataFrame(planted or [("", -1, 0)], "sentence string, doc_id long, rule int")
    spots = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.pmod(F.xxhash64("doc_id", "rule", F.lit(seed)), F.lit(words_per_doc + 1)).alias("at"), "sentence"))).alias("spots"))
    words = F.transform(F.sequence(F.lit(0), F.lit(words_per_doc - 1)), lambda i: unique_word(F.col("doc_id") * words_per_doc + i, seed))
    made = docs.select("doc_id", words.alias("words")).join(F.broadcast(spots), "doc_id", "left")
    # from the last place to the first, so that places stay true
    text = F.aggregate(
        F.reverse(F.coalesce("spots", F.array().cast("array<struct<at:bigint,sentence:string>>"))),
        F.col("words"),
        lambda acc, s: F.concat(F.slice(acc, F.lit(1), s["at"].cast("int")), F.array(s["sentence"]), F.slice(acc, s["at"].cast("int") + 1, F.size(acc))),
    )
    return made.select("doc_id", F.format_string("test_file_%d.txt", "doc_id").alias("source"), F.array_join(text, " ").alias("text"))
