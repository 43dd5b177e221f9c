"""Corpora: (doc_id BIGINT, source STRING, text STRING) from files, delimited text or any table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions.text import decode_bytes


def records(text: str, delimiter: str = ",") -> Iterator[str]:
    """The records of delimited text, each with its fields joined by a space.

    A quote opens or closes quoting anywhere in a field, and two quotes inside quoting are one; a line end inside quotes
    stays. CR, LF and CR LF end a record; the delimiter is looked at first. Records that are empty after joining don't
    count, widths may differ, and there is no header.
    """
    fields: list[str] = []
    field: list[str] = []
    quoted, k, size = False, 0, len(text)

    def joined() -> str:
        return " ".join(f for f in [*fields, "".join(field)]) if any(fields) or field else ""

    while k < size:
        c = text[k]
        if quoted:
            if c == '"' and text[k + 1 : k + 2] == '"':
                field.append('"')
                k += 1
            elif c == '"':
                quoted = False
            else:
                field.append(c)
        elif c == '"':
            quoted = True
        elif c == delimiter:
            fields.append("".join(field))
            field = []
        elif c in "\r\n":
            if c == "\r" and text[k + 1 : k + 2] == "\n":
                k += 1
            if record := joined():
                yield record
            fields, field = [], []
        else:
            field.append(c)
        k += 1
    if record := joined():
        yield record


def delimiter_of(option: str) -> str:
    """The option as a character: the two-letter escapes for tab and line end, else its first character."""
    return {"\\t": "\t", "\\n": "\n"}.get(option, option[:1] or ",")


def read_directory(spark: SparkSession, path: str, mask: str = "") -> DataFrame:
    """One document for each file below path. mask: empty or * for all, *.ext for an extension, else a file's exact name.

    Ids follow the sorted paths, so they don't depend on how the listing comes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if mask and mask != "*":
        reader = reader.option("pathGlobFilter", mask)
    files = reader.load(path).select(F.col("path").alias("source"), decode_bytes("content").alias("text"))
    return with_ids(files, "source")


def with_ids(df: DataFrame, *order: str) -> DataFrame:
    """df with doc_id, gapless from 0 by the order: ranges are sorted apart, and each range starts where the ones before end."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    from phraseloom.plans.tables import settle

    held = settle(ranged.withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)), "ids")
    counts = {r["_part"]: r["count"] for r in held.groupBy("_part").count().collect()}  # a row for each partition
    before, starts = 0, []
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    return held.join(F.broadcast(offsets), "_part").select((F.col("_start") + F.col("_k")).alias("doc_id"), *df.columns)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """One document for each record of a delimited file (or of each file of a folder), labelled row_0, row_1 and so on.

    A quoted field may hold line ends, so where a record begins depends on all that stands before it: a file is read by
    one task. Large corpora come as many files, or through from_table().
    """
    mark = delimiter_of(delimiter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows: list[str] = []
                first = 0
                for r in records(text or "", mark):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield _rows(path, first, rows)
                        first, rows = first + len(rows), []
                if rows:
                    yield _rows(path, first, rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", decode_bytes("content").alias("text"))
    out = files.mapInArrow(run, "path string, row long, text string")
    return with_ids(out, "path", "row").select("doc_id", F.concat(F.lit("row_"), F.col("doc_id").cast("string")).alias("source"), "text")


def _rows(path: str, first: int, rows: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows)], names=["path", "row", "text"])


def from_table(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str | None = None) -> DataFrame:
    """A corpus from any table with an id and a text."""
    source = F.col(source_column) if source_column else F.col(id_column).cast("string")
    return df.select(F.col(id_column).cast("long").alias("doc_id"), source.alias("source"), F.col(text_column).alias("text"))


def read_corpus(spark: SparkSession, path: str, mask: str = "", delimiter: str = ",", sampling: float = 1.0, seed: int = 0) -> DataFrame:
    """A corpus from a path: Parquet by its ending, any other single file as delimited text, a folder as files.

    sampling below 1 keeps that share of the documents, exactly and repeatably; ids stay those of the whole corpus.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise FileNotFoundError(path)
    if path.rstrip("/").endswith(".parquet"):
        corpus = from_table(spark.read.parquet(path))
    elif system.getFileStatus(where).isFile():
        corpus = read_delimited(spark, path, delimiter)
    else:
        corpus = read_directory(spark, path, mask)
    if sampling < 1.0:
        from phraseloom.operators.sequences import exact_sample

        corpus = exact_sample(corpus, sampling, seed)
    return corpus


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, freq, length, example_files) from a result file; its byte order mark tells the encoding, else UTF-8, else Latin-1.

    Every phrase is kept as text, also one that reads like a missing value.
    """
    head = spark.read.format("binaryFile").load(path).select(F.hex(F.substring("content", 1, 3)).alias("h"), F.expr("is_valid_utf8(content)").alias("ok")).first()
    name = "UTF-16" if head["h"][:4] in ("FFFE", "FEFF") else "UTF-8" if head["ok"] else "ISO-8859-1"
    raw = spark.read.option("header", True).option("encoding", name).option("escape", '"').option("multiLine", True).option("nullValue", "\0").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return raw.select(*[F.col(c).cast("long").alias(c) if c in ("freq", "length", "doc_count", "word_count") else F.col(c) for c in raw.columns])
