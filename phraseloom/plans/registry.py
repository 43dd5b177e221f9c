"""The miners by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.operators import bounded, miners, sequences
from phraseloom.operators.miners import Params


def _bounded(rule: str, tokens: DataFrame, p: Params, max_length: int) -> DataFrame:
    found = bounded.all_frequent(tokens, p.shortest, max_length, p.min_docs) if rule == "all" else bounded.reduced(tokens, rule, p.shortest, max_length, p.min_docs)
    return found.select("phrase", F.col("df").alias("freq"), "length", F.lit("").alias("example_files"))


def mine(tokens: DataFrame, algorithm: str, p: Params, sources: DataFrame | None = None, max_length: int = 16, strict_compat: bool = False) -> DataFrame:
    """(phrase, freq, length, example_files) by the named miner.

    default, greedy or bloom: greedy with coverage; bide, clospan: closed by occurrences (one result, two names);
    prefixspan: closed to the right by documents; all, maximal, closed, right_maximal: by documents, up to max_length;
    gapped: sequences with gaps.
    """
    columns = ("phrase", "freq", "length", "example_files")
    if algorithm in ("default", "greedy", "bloom"):
        return miners.mine_default(tokens, p, sources).orderBy(F.desc("seed_df"), "seed").select(*columns)
    if algorithm in ("bide", "clospan"):
        return miners.mine_closed(tokens, p, sources).select(*columns)
    if algorithm == "prefixspan":
        return miners.mine_closed(tokens, p, sources, unit="documents", left=False, strict_compat=strict_compat).select(*columns)
    if algorithm in ("all", "maximal", "closed", "right_maximal"):
        return _bounded(algorithm, tokens, p, max_length)
    if algorithm == "gapped":
        return sequences.gapped_patterns(tokens, p.min_docs, max_length).where(F.col("length") >= p.shortest).withColumn("example_files", F.lit(""))
    raise ValueError(f"unknown algorithm: {algorithm}")
