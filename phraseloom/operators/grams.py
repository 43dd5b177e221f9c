"""Positions, vocabulary and n-gram support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.functions.text import starts, tokenize


def with_tokens(corpus: DataFrame) -> DataFrame:
    """(doc_id, tokens) of a corpus (doc_id, text)."""
    return corpus.select("doc_id", tokenize("text").alias("tokens"))


def positions(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, token), pos from 0."""
    return tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token"))


def doc_stats(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_distinct)."""
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, df, cf): document and corpus frequency.

    Two shuffles: one counts each token within its document, the other, of those counts, sums over documents.
    """
    within = tokens.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return within.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def frequent_only(vocab: DataFrame, min_docs: int) -> DataFrame:
    return vocab.where(F.col("df") >= min_docs)


def gram_rows(tokens: DataFrame, n: int) -> DataFrame:
    """(doc_id, pos, gram): every contiguous n-gram, pos from 0; shorter documents have none."""
    gram = F.transform(starts("tokens", n), lambda i: F.array_join(F.slice("tokens", i, F.lit(n)), " "))
    return tokens.select("doc_id", F.posexplode(gram).alias("pos", "gram"))


def support(tokens: DataFrame, n: int, min_docs: int = 1) -> DataFrame:
    """(gram, df, occ) of the n-grams in at least min_docs documents.

    Two shuffles: one counts each gram within its document, the other sums over documents.
    """
    rows = gram_rows(tokens, n)
    per_doc = rows.groupBy("gram", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("gram").agg(F.count("*").alias("df"), F.sum("n").alias("occ")).where(F.col("df") >= min_docs)


def bucket_prefilter(tokens: DataFrame, n: int, min_docs: int, buckets: int = 1 << 22) -> DataFrame:
    """(doc_id, pos, gram) of grams whose hash bucket holds at least min_docs occurrences: a superset of the frequent grams' rows.

    The counts of one bucket only over-estimate, so no frequent gram is lost; the bucket table has at most ``buckets``
    rows, whatever the input.
    """
    rows = gram_rows(tokens, n).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    full = rows.groupBy("bucket").count().where(F.col("count") >= min_docs).select("bucket")
    return rows.join(full, "bucket", "left_semi").select("doc_id", "pos", "gram")


def seeds(tokens: DataFrame, n: int, min_docs: int, prefilter: bool = False) -> DataFrame:
    """(gram, df, occ, length, score) of the frequent n-grams; score is df times length."""
    if prefilter:
        rows = bucket_prefilter(tokens, n, min_docs)
        per_doc = rows.groupBy("gram", "doc_id").agg(F.count("*").alias("k"))
        found = per_doc.groupBy("gram").agg(F.count("*").alias("df"), F.sum("k").alias("occ")).where(F.col("df") >= min_docs)
    else:
        found = support(tokens, n, min_docs)
    return found.select("gram", "df", "occ", F.lit(n).cast("long").alias("length"), (F.col("df") * n).alias("score"))


def top_seeds(found: DataFrame, k: int) -> DataFrame:
    """The k best seeds by score, ties by the gram."""
    return found.orderBy(F.desc("score"), F.asc("gram")).limit(k)


def neighbours(tokens: DataFrame, n: int, side: str) -> DataFrame:
    """(gram, doc_id, other): each occurrence of an n-gram with the token after ("next") or before ("prev") it, null at the end or start."""
    at = (lambda i: i + n) if side == "next" else (lambda i: i - 1)
    size = F.size("tokens")
    seen = F.transform(
        starts("tokens", n),
        lambda i: F.struct(
            F.array_join(F.slice("tokens", i, F.lit(n)), " ").alias("gram"),
            F.when((at(i) >= 1) & (at(i) <= size), F.get("tokens", at(i) - 1)).alias("other"),
        ),
    )
    return tokens.select("doc_id", F.explode(seen).alias("x")).select("x.gram", "doc_id", "x.other")


def neighbour_support(tokens: DataFrame, n: int, min_docs: int, side: str) -> DataFrame:
    """(gram, other, df, occ): for each frequent gram, each token beside it."""
    rows = neighbours(tokens, n, side).join(support(tokens, n, min_docs).select("gram"), "gram", "left_semi").where(F.col("other").isNotNull())
    per_doc = rows.groupBy("gram", "other", "doc_id").agg(F.count("*").alias("k"))
    return per_doc.groupBy("gram", "other").agg(F.count("*").alias("df"), F.sum("k").alias("occ"))


def best_next(tokens: DataFrame, n: int, min_docs: int) -> DataFrame:
    """(gram, token, df, occ): the extension of each gram with the most documents, then occurrences, then the first by name."""
    found = neighbour_support(tokens, n, min_docs, "next").where(F.col("df") >= min_docs)
    order = Window.partitionBy("gram").orderBy(F.desc("df"), F.desc("occ"), F.asc("other"))
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").select("gram", F.col("other").alias("token"), "df", "occ")


def uniform(value: str) -> Column:
    """Whether all rows of a group have the same value, and none a null."""
    return (F.count(value) == F.count(F.lit(1))) & (F.min(value) == F.max(value))


def one_sided_closed(tokens: DataFrame, n: int, min_docs: int, side: str) -> DataFrame:
    """(gram, df, occ) of the frequent n-grams that not all occurrences extend by the same token on that side."""
    rows = neighbours(tokens, n, side)
    per_doc = rows.groupBy("gram", "doc_id").agg(F.count("*").alias("n"), F.count("other").alias("k"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    whole = per_doc.groupBy("gram").agg(F.count("*").alias("df"), F.sum("n").alias("occ"), F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return whole.where((F.col("df") >= min_docs) & ~((F.col("k") == F.col("occ")) & (F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))))).select("gram", "df", "occ")
