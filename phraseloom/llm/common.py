"""What the operators of this subpackage share: tables, scratch storage on the shared folder, Arrow maps, samples.

Rules that hold for every operator here:

* a document is a row of a table with ``doc_id`` and ``text``; both may be null (a null text is treated as
  the empty text, a null id as an id like any other);
* operators read the columns they need by name and return only the columns they document, so further
  columns of the input, whatever their names, neither clash nor matter;
* intermediate results that are read more than once are written as Parquet in the shared folder that the
  session names in ``spark.checkpoint.dir``, so that they survive the loss of executors.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: the space and U+0009 to U+000D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word, as a pattern for Python and for Java.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch at most, and the bytes of a batch beyond which it is worked on in parts.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, and only where that is unset in local mode (tests) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="phraseloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phraseloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        df._stored_at = None


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, on machines that have it at the same place."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(":"):
        held["PYTHONPATH"] = ":".join(filter(None, [root, held.get("PYTHONPATH", "")]))


def _give_back() -> None:
    """Return freed memory to the machine: a worker lives on between tasks, and its memory counts for its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow by batches of a bounded number of rows, and in parts of about BATCH_BYTES where rows are long.

    Spark reads the number of rows from the session when the query runs, so it is set there and stays. after is called at
    the end of each task, to give back what the worker, which goes on to other tasks, holds.
    """
    importable(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)) if batch.nbytes > BATCH_BYTES else batch.num_rows
            for k in range(0, batch.num_rows, max(1, rows)):
                yield function(batch.slice(k, rows))
            _give_back()
        if after is not None:
            after()
            _give_back()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str | int = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in fold 0 of none and so gives null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


#: Bytes of labelled texts that a fit may fetch at most.
SAMPLE_BYTES = 64 << 20


def fetched(rows: DataFrame, limit: int = SAMPLE_BYTES) -> list[dict]:
    """The rows (doc_id, text, label) of a sample of a bounded number of rows, by doc_id; by a hash of the id as many as have limit bytes of text."""
    rows = stored(rows, "sample")
    sizes = rows.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("doc_id", F.lit(2)).alias("h")).collect()
    total, kept = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], str(r["doc_id"]), str(r["label"]))):
        if total + r["size"] <= limit:
            total += r["size"]
            kept.append(r["doc_id"])
    if len(kept) < len(sizes):
        rows = rows.where(F.col("doc_id").isin(kept))
    out = rows.toArrow().to_pylist()
    discard(rows)
    return sorted(out, key=lambda r: (r["doc_id"], str(r["label"])))


def labelled_ids(labels: DataFrame, column: str, usable: Column) -> DataFrame:
    """(doc_id, label) of all ids with label 0 or 1; those with both, or with null, are left out."""
    own = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    return own.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("most")).where("label = most").select("doc_id", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, usable: Column) -> DataFrame:
    """(doc_id, text, label) of at most per_class documents of each label 0 and 1, by the order of a hash of the id.

    Ids with a null label, or with both labels, are left out. The ids are found on the narrow label table; only their
    texts are read.
    """
    own = labelled_ids(labels, column, usable)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [own.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # at most 2 * per_class rows of two numbers: safe to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


#: Bytes of rows that may be broadcast, and of each column of a row that isn't a string or an array.
BROADCAST_BYTES, FIXED_WIDTH = 32 << 20, 16


def bounded_broadcast(rows: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows, to be broadcast if they are small by their own bytes; else as they are, for a shuffle join. rows should be a stored table."""
    wide = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    fixed = FIXED_WIDTH * len(rows.columns)
    size = F.coalesce(F.sum(sum((F.coalesce(F.octet_length(w), F.lit(0)) for w in wide), F.lit(fixed))), F.lit(0))
    return F.broadcast(rows) if rows.agg(size.alias("size")).first()["size"] <= limit else rows


def free_name(taken: list[str], wanted: str) -> str:
    """wanted, or with a number behind it, so that no column of the table has the name in any case of letters."""
    held, out, k = {t.lower() for t in taken}, wanted, 0
    while out.lower() in held:
        k += 1
        out = f"{wanted}_{k}"
    return out


def _by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    name = free_name(docs.columns, "other_id")
    other = bounded_broadcast(ids.select("doc_id")).withColumnRenamed("doc_id", name)
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col(name)), how)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is none of ids (a stored table with doc_id); null ids count; other columns of any name stay as they are."""
    return _by_ids(docs, ids, "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is one of ids, likewise."""
    return _by_ids(docs, ids, "left_semi")
