"""The queries of this subpackage for __spark_entry__.py: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phraseloom.llm.common import fold, table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.llm.simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.llm.quality_rules import fit, score_table

    docs = table(spark, sf_dir, "documents")
    return score_table(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, digest=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.llm.decontamination import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.llm.toxicity import fit, score_table

    docs = table(spark, sf_dir, "documents")
    return score_table(docs, fit(docs, table(spark, sf_dir, "labels"), usable=fold("doc_id", 5) != 0), threshold=0.5)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.llm.url_filter import Rule, judge, labelled_table, out_of_fold, threshold_of, train

    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
    labelled = labelled_table(spark)
    return judge(table(spark, sf_dir, "pages"), rules, train(labelled), threshold_of(out_of_fold(labelled)))


def op7_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.llm.language_ecoc import fit, predict_table

    docs = table(spark, sf_dir, "documents")
    return predict_table(docs, fit(docs, fold("doc_id", 4) != 2))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from phraseloom.llm.bpe import encode_table

    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_table(table(spark, sf_dir, "documents"), path, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.llm.quality_compression import fit, score_table

    docs = table(spark, sf_dir, "documents")
    return score_table(docs, fit(docs, table(spark, sf_dir, "labels"), usable=fold("doc_id", 5) != 0), threshold=0.3)


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.llm.kd_sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), 8)


OP3 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, key IN (SELECT key FROM frequent) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3}
