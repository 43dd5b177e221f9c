"""The phrase hierarchy: parents, levels, scores, the best phrases with their ancestors, and the nested form for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.functions.text import display_phrase, normalize_phrase, pareto_score
from phraseloom.plans.tables import settle


def clean_results(results: DataFrame, min_length: int = 0, min_freq: int = 0) -> DataFrame:
    """Results with the usual column names, without null phrases, and over the two bounds (0: no bound)."""
    for old, new in (("doc_count", "freq"), ("word_count", "length")):
        if old in results.columns and new not in results.columns:
            results = results.withColumnRenamed(old, new)
    return results.where(F.col("phrase").isNotNull() & (F.col("length") >= min_length) & (F.col("freq") >= min_freq))


def numbered(results: DataFrame) -> DataFrame:
    """Normalised phrases with id: the number, from 0, by length and then phrase.

    Numbers run within each length, after the number of shorter phrases; no task sorts the whole table.
    """
    own = results.withColumn("phrase", normalize_phrase("phrase"))
    counts = own.groupBy("length").agg(F.count("*").alias("n"))
    shorter = counts.alias("a").join(counts.alias("b"), F.col("b.length") < F.col("a.length"), "left").groupBy(F.col("a.length").alias("length")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    order = Window.partitionBy("length").orderBy("phrase", "freq")
    return own.withColumn("_k", F.row_number().over(order)).join(shorter, "length").withColumn("id", (F.col("before") + F.col("_k") - 1).cast("long")).drop("_k", "before")


def parents(phrases: DataFrame) -> DataFrame:
    """phrases (id, phrase, ...) with parent_id: the longest other phrase that is a suffix or prefix, of two words at least; null if none.

    On equal length the suffix wins; of equal phrases the one with the largest id is the parent. Candidates meet by the
    number of words and a hash of them, and their texts are compared then; no shortened text is shuffled.
    """
    base = phrases.select("id", "phrase", F.split("phrase", " ").alias("words"))
    size = F.size("words")
    hashed = F.transform(F.sequence(F.lit(1), size - 2), lambda d: F.struct(d.alias("drop"), F.xxhash64(F.slice("words", d + 1, size - d)).alias("s"), F.xxhash64(F.slice("words", F.lit(1), size - d)).alias("p")))
    short = base.where(size > 2).select("id", "phrase", size.alias("n"), F.explode(hashed).alias("x"))
    keys = short.select("id", "phrase", (F.col("n") - F.col("x.drop")).alias("m"), F.col("x.drop").alias("drop"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("x.s").alias("h")), F.struct(F.lit(1).alias("kind"), F.col("x.p").alias("h")))).alias("y"))
    keys = keys.select("id", "phrase", "m", "drop", "y.kind", "y.h")
    target = base.groupBy("phrase").agg(F.max("id").alias("parent_id")).select(F.col("phrase").alias("parent"), "parent_id", F.split("phrase", " ").alias("w")).select("parent", "parent_id", F.size("w").alias("m"), F.xxhash64("w").alias("h"))
    fits = F.when(F.col("kind") == 0, F.col("phrase").endswith(F.col("parent"))).otherwise(F.col("phrase").startswith(F.col("parent")))
    best = keys.join(target, ["m", "h"]).where(fits).groupBy("id").agg(F.min_by("parent_id", F.struct("drop", "kind")).alias("parent_id"))
    return phrases.join(best, "id", "left")


def levels(tree: DataFrame) -> DataFrame:
    """tree (id, parent_id, ...) with level: 0 for roots, else the parent's and 1. Pointers double, so rounds follow the log of the depth."""
    jump = settle(tree.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
    while not jump.where("up IS NOT NULL").isEmpty():
        above = jump.select(F.col("id").alias("up"), F.col("up").alias("upper"), F.col("level").alias("more"))
        jump = settle(jump.join(above, "up", "left").select("id", F.col("upper").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
    return tree.join(jump.select("id", "level"), "id")


def build_tree(results: DataFrame) -> DataFrame:
    """(id, phrase, freq, length, example_files if there, parent_id, level) of a result table."""
    return levels(settle(parents(settle(numbered(results), "phrases")), "parents"))


def scored(tree: DataFrame) -> DataFrame:
    """tree with score, unless it has one. The two maxima are one row."""
    if "score" in tree.columns:
        return tree
    most = tree.agg(F.max("length").alias("max_length"), F.max("freq").alias("max_freq"))
    return tree.join(F.broadcast(most)).withColumn("score", pareto_score("length", "freq", "max_length", "max_freq")).drop("max_length", "max_freq")


def top_with_ancestors(tree: DataFrame, limit: int = 15000) -> DataFrame:
    """The limit best rows by score (ties by id), and all their ancestors."""
    tree = settle(scored(tree), "scored")
    links = tree.select("id", "parent_id")
    chosen = settle(tree.orderBy("score", "id").limit(limit).select("id"), "top")
    new = chosen
    while True:
        up = links.join(new, "id").where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
        new = settle(up.join(chosen, "id", "left_anti"), "ancestors")
        if new.isEmpty():
            return tree.join(chosen, "id", "left_semi")
        chosen = settle(chosen.unionByName(new), "chosen")


def with_display(tree: DataFrame) -> DataFrame:
    """tree with display_phrase: the phrase relative to its parent's."""
    up = tree.select(F.col("id").alias("parent_id"), F.col("phrase").alias("_parent"))
    return tree.join(up, "parent_id", "left").withColumn("display_phrase", display_phrase("phrase", "_parent")).drop("_parent")


def forest(rows: list[dict]) -> list[dict]:
    """Rows nested by parent_id, with chains of only children collapsed to their longest member; children by freq downwards.

    For display, after top_with_ancestors() has bounded the rows. No recursion, so depth is no limit.
    """
    nodes = {r["id"]: dict(r, children=[]) for r in rows}
    roots = []
    for n in nodes.values():
        up = nodes.get(n["parent_id"]) if n["parent_id"] is not None else None
        (up["children"] if up else roots).append(n)
    top: list[dict] = []
    work = [(r, None, top) for r in roots]
    while work:
        node, parent, into = work.pop()
        while len(node["children"]) == 1:
            node = node["children"][0]
        below, node["children"] = node["children"], []
        shown = node["phrase"]
        if parent and parent in shown:
            shown = " ".join(shown.replace(parent, " <PARENT> ").split())
        node["display_phrase"] = shown
        into.append(node)
        work += [(child, node["phrase"], node["children"]) for child in below]
    every = [top]
    while every:
        level = every.pop()
        level.sort(key=lambda n: (-n["freq"], n["id"]))
        every += [n["children"] for n in level if n["children"]]
    return top
