"""Line dedup with exact reference counts and sharded cuckoo filters; reversible by document.

State. Each line key has an exact reference count: the number of documents that hold it. Keys are known by a 128-bit
hash of the stripped, ASCII-lower-cased line; the count table is a plain table (hi, lo, n_docs), built with one
distinct aggregation and no lists. Inserting documents adds their counts, deleting documents subtracts them, so an
index after insert and delete equals the index of the documents that remain.

Filters. The keys at or over the threshold are dealt into shards by their hash, and each shard has a cuckoo filter (two
buckets for a key, four 32-bit tags in a bucket, insertion by moving tags, deletion by removing one), stored by shard.
When counts change, the keys that cross the threshold are added to their shards' filters or removed from them; the other
shards' files stay as they are. Only a shard whose filter has become too full is built anew, with more room.

A line whose tag is in neither of its buckets is kept. What the filters pass is looked up in the exact count table, once
for all documents: the few keys that the filters pass although they are under the threshold are found by one map over the
count table. So a line goes if its filter passes it and it is none of these.

Dropping is a pass over the texts without a shuffle as long as filters and wrongly passed keys have ``broadcast_bytes`` at
most, which is checked by their real sizes; beyond that, lines are joined with the exact table by their hash and the
dropped keys come back to their documents by a second join, without filters. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.llm.common import SPACE, arrow_map, discard, free_name, importable, shared_dir, stored, texts_of

_upper = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_space = SPACE.encode()
SLOTS = 4
#: Keys in one shard's filter, about, when an index is begun; and the share of a filter's places from which it is built anew.
SHARD_KEYS, FULL = 100_000, 0.9


def line_hash(line: bytes) -> tuple[int, int] | None:
    """The 128-bit hash of a line's key as two signed numbers; None for an empty key."""
    key = line.strip(_space).translate(_upper)
    if not key:
        return None
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class CuckooFilter:
    """Tags of 64-bit hashes; may say yes by chance (about 8 in 2^32), never no for what was added."""

    def __init__(self, keys: int, seed: int = 7) -> None:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8))))
        self.mask = buckets - 1
        self.tags = np.zeros((buckets, SLOTS), np.uint32)
        self.random = np.random.default_rng(seed)
        self.spilled: list[int] = []  # hashes for which no place was found, kept whole

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h.astype(np.uint64)
        tag = np.maximum((h >> np.uint64(32)).astype(np.int64), 1)
        first = (h & np.uint64(self.mask)).astype(np.int64)
        return tag, first, self._other(first, tag)

    def _other(self, bucket, tag):
        """The second bucket of a tag; of that one, the first again."""
        return bucket ^ ((tag * 0x5BD1E995) & self.mask)

    def add(self, h: int) -> None:
        tag, first, second = (int(x[0]) for x in self._places(np.array([h & ((1 << 64) - 1)], np.uint64)))
        for bucket in (first, second):
            free = np.flatnonzero(self.tags[bucket] == 0)
            if len(free):
                self.tags[bucket, free[0]] = tag
                return
        bucket, moves = first, []
        for _ in range(500):
            slot = int(self.random.integers(SLOTS))
            moves.append((bucket, slot))
            tag, self.tags[bucket, slot] = int(self.tags[bucket, slot]), tag
            bucket = int(self._other(bucket, tag))
            free = np.flatnonzero(self.tags[bucket] == 0)
            if len(free):
                self.tags[bucket, free[0]] = tag
                return
        for bucket, slot in reversed(moves):  # undo, so that no other tag is lost
            tag, self.tags[bucket, slot] = int(self.tags[bucket, slot]), tag
        self.spilled.append(h & ((1 << 64) - 1))

    def remove(self, h: int) -> bool:
        """Take out one that was added before."""
        if (h & ((1 << 64) - 1)) in self.spilled:
            self.spilled.remove(h & ((1 << 64) - 1))
            return True
        tag, first, second = (int(x[0]) for x in self._places(np.array([h & ((1 << 64) - 1)], np.uint64)))
        for bucket in (first, second):
            held = np.flatnonzero(self.tags[bucket] == tag)
            if len(held):
                self.tags[bucket, held[0]] = 0
                return True
        return False

    def full(self) -> bool:
        return bool(self.spilled) or np.count_nonzero(self.tags) > FULL * self.tags.size

    def has(self, h: np.ndarray) -> np.ndarray:
        tag, first, second = self._places(h.astype(np.int64).view(np.uint64))
        found = (self.tags[first] == tag[:, None]).any(1) | (self.tags[second] == tag[:, None]).any(1)
        return found | np.isin(h.astype(np.int64).view(np.uint64), np.array(self.spilled, np.uint64)) if self.spilled else found

    def pack(self) -> bytes:
        return len(self.spilled).to_bytes(4, "little") + np.array(self.spilled, "<u8").tobytes() + self.tags.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> CuckooFilter:
        out, n = cls(1), int.from_bytes(data[:4], "little")
        out.spilled = np.frombuffer(data[4 : 4 + 8 * n], "<u8").tolist()
        out.tags = np.frombuffer(data[4 + 8 * n :], "<u4").reshape(-1, SLOTS).copy()
        out.mask = len(out.tags) - 1
        return out


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo): the keys of each row's lines, once a row. Null and empty texts have none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hi, lo, at = [], [], []
        for k, text in enumerate(texts_of(batch)):
            found = {line_hash(x) for x in text.encode("utf-8", "replace").split(b"\n")} - {None}
            hi += [h for h, _ in found]
            lo += [x for _, x in found]
            at += [k] * len(found)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["doc_id", "hi", "lo"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, hi long, lo long")


def reference_counts(docs: DataFrame) -> DataFrame:
    """(hi, lo, n_docs): documents are told apart by doc_id, so rows that repeat an id count once; all null ids are one document."""
    return line_keys(docs).distinct().groupBy("hi", "lo").agg(F.count("*").alias("n_docs"))


def combined(counts: DataFrame, change: DataFrame, sign: int = 1) -> DataFrame:
    """The counts after documents with the counts ``change`` came (1) or went (-1). Keys that nobody holds any more go."""
    return counts.unionByName(change.withColumn("n_docs", F.col("n_docs") * sign)).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs")).where("n_docs <> 0")


def shard_of(shards: int):
    return F.pmod("lo", F.lit(shards)).cast("int")


def build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, filter, full): a packed cuckoo filter for each shard of the keys (hi, lo), with room for a quarter more."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes = table.column("hi").to_numpy()
        own = CuckooFilter(len(hashes) * 5 // 4)
        for h in np.sort(hashes).tolist():
            own.add(h)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([own.pack()], pa.binary()), "full": pa.array([False])})

    importable(frequent.sparkSession)
    return frequent.select(shard_of(shards).alias("shard"), "hi").groupBy("shard").applyInArrow(run, "shard int, filter binary, full boolean")


def changed_filters(filters: DataFrame, crossing: DataFrame, shards: int) -> DataFrame:
    """(shard, filter, full): the filters of the shards that crossing (hi, lo, up) touches, with its keys added (up) or removed."""

    def run(key: tuple, old: pa.Table, table: pa.Table) -> pa.Table:
        hashes, up = table.column("hi").to_numpy(), table.column("up").to_numpy(zero_copy_only=False)
        own = CuckooFilter.unpack(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter(len(hashes) * 5 // 4)
        for h in np.sort(hashes[~up]).tolist():
            own.remove(h)
        for h in np.sort(hashes[up]).tolist():
            own.add(h)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([own.pack()], pa.binary()), "full": pa.array([own.full()])})

    importable(crossing.sparkSession)
    touched = crossing.select(shard_of(shards).alias("shard"), "hi", "up")
    held = filters.join(touched.select("shard").distinct(), "shard", "left_semi").select("shard", "filter")
    return held.groupBy("shard").cogroup(touched.groupBy("shard")).applyInArrow(run, "shard int, filter binary, full boolean")


class LineIndex:
    """Reference counts and filters, stored under a path; changed by insert() and delete(), used by apply().

    insert() and delete() take tables of documents; a document has to be deleted with the text it was inserted with.
    Each call writes a new generation, so a job that fails half-way leaves the index as it was. Filters are written by shard,
    and only those that change; the number of shards is set by the first call.
    """

    def __init__(self, spark, path: str | None = None, min_docs: int = 10, shard_keys: int = SHARD_KEYS) -> None:
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/phraseloom-lines-{uuid.uuid4().hex}"
        self.min_docs, self.shard_keys, self.generation = min_docs, shard_keys, 0
        self.counts: DataFrame | None = None
        self.shards = 1
        self.written: dict[int, int] = {}  # the generation of each shard's filter

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{self.generation}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.generation}/{name}")

    @property
    def frequent(self) -> DataFrame:
        """(hi, lo): the keys at or over the threshold."""
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("hi", "lo")

    @property
    def n_frequent(self) -> int:
        return self.frequent.count()

    @property
    def filters(self) -> DataFrame:
        """(shard, filter) of all shards, from the generations that wrote them."""
        parts = [self.spark.createDataFrame([], "shard int, filter binary")]
        for k in sorted(set(self.written.values())):
            own = [s for s, g in self.written.items() if g == k]
            parts.append(self.spark.read.schema("filter binary, shard int").parquet(f"{self.path}/{k}/filters").where(F.col("shard").isin(own)).select("shard", "filter"))
        return reduce(DataFrame.unionByName, parts)

    def _write_filters(self, made: DataFrame, name: str = "filters") -> list[int]:
        """Write filters into this generation, a folder for each shard; returns the shards that are too full."""
        made = stored(made, "filters")
        made.select("shard", "filter").write.mode("append").partitionBy("shard").parquet(f"{self.path}/{self.generation}/{name}")
        rows = made.select("shard", "full").collect()  # a number for each shard
        discard(made)
        self.written |= {r["shard"]: self.generation for r in rows}
        return [r["shard"] for r in rows if r["full"]]

    def _change(self, docs: DataFrame, sign: int) -> LineIndex:
        self.generation += 1
        change = reference_counts(docs)
        if self.counts is None:
            self.counts = self._write(change.withColumn("n_docs", F.col("n_docs") * sign), "counts")
            self.shards = max(1, -(-self.n_frequent // self.shard_keys))
            self._write_filters(build_filters(self.frequent, self.shards))
            return self
        change = stored(change, "line-changes")
        old = self.counts
        self.counts = self._write(combined(old, change, sign), "counts")
        both = change.select("hi", "lo", F.col("n_docs").alias("n_change")).join(old, ["hi", "lo"], "left")
        before = F.coalesce("n_docs", F.lit(0))
        was, now = before >= self.min_docs, before + F.col("n_change") * sign >= self.min_docs
        crossing = stored(both.select("hi", "lo", was.alias("was"), now.alias("up")).where("was <> up").drop("was"), "line-crossing")
        filters = self.filters
        full = self._write_filters(changed_filters(filters, crossing, self.shards))
        if full:
            self.generation += 1  # of the counts nothing is written here
            self._write_filters(build_filters(self.frequent.where(shard_of(self.shards).isin(full)), self.shards))
        discard(change)
        discard(crossing)
        return self

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._change(docs, -1)

    def apply(self, docs: DataFrame, broadcast_bytes: int = 64 << 20, digest: bool = False) -> DataFrame:
        """docs with the frequent lines taken out of text, or with digest=True (doc_id, n_lines, n_dropped, kept_sha256).

        A null or empty text is one empty line, which stays; a text all of whose lines go becomes empty. n_chars, where
        docs has it, follows the new text. All other columns stay as they are.
        """
        filters = self.filters
        size = filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0)).alias("size")).first()["size"]
        if size <= broadcast_bytes and broadcast_bytes > 0:
            probe = Probe(self.spark, {r["shard"]: r["filter"] for r in filters.toArrow().to_pylist()}, self.shards)
            rare = self.counts.where(F.col("n_docs") < self.min_docs).select("hi", "lo")
            wrong = stored(_passed(rare, probe), "wrongly-passed-lines")
            if size + wrong.count() * 16 <= broadcast_bytes:
                probe.wrong = frozenset(map(tuple, wrong.collect()))
                return _map_lines(docs, probe, digest)
        return _join_lines(docs, self.frequent, digest)


class Probe:
    """The packed filters and the few keys that they pass wrongly, for the workers."""

    def __init__(self, spark, packed: dict[int, bytes], shards: int) -> None:
        self.held, self.shards, self.wrong = spark.sparkContext.broadcast(packed), shards, frozenset()
        self.opened: dict[int, CuckooFilter] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    def passed(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether the filters pass the keys."""
        out, shard = np.zeros(len(hi), bool), lo % self.shards
        for s in np.unique(shard).tolist():
            if s in self.held.value:
                if s not in self.opened:
                    self.opened[s] = CuckooFilter.unpack(self.held.value[s])
                at = shard == s
                out[at] = self.opened[s].has(hi[at])
        return out

    def dropped(self, hashes: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """Those of the keys that are frequent."""
        if not hashes:
            return set()
        hi, lo = np.array(hashes, np.int64).T
        return {hashes[k] for k in np.flatnonzero(self.passed(hi, lo)).tolist()} - self.wrong


def _passed(keys: DataFrame, probe: Probe) -> DataFrame:
    """Those of the keys (hi, lo) that the filters pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hi, lo = (batch.column(n).to_numpy() for n in ("hi", "lo"))
        return batch.filter(pa.array(probe.passed(hi, lo)))

    return arrow_map(keys, run, "hi long, lo long")


def _finished(batch: pa.RecordBatch, lines: list[list[bytes]], kept: list[list[bytes]], digest: bool) -> pa.RecordBatch:
    joined = [b"\n".join(k) for k in kept]
    if digest:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, lines), pa.int64()), pa.array([len(a) - len(b) for a, b in zip(lines, kept, strict=True)], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )
    new = pa.array([j.decode() for j in joined], pa.string())
    columns = []
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if name == "text":
            same = pa.array([len(a) == len(b) for a, b in zip(lines, kept, strict=True)])
            column = pa.compute.if_else(same, column.cast(pa.string()), new)
        elif name == "n_chars":
            column = pa.array([len(j.decode()) for j in joined], pa.int64()).cast(column.type)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _schema_of(docs: DataFrame, digest: bool):
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string" if digest else docs.schema


def _map_lines(docs: DataFrame, probe: Probe, digest: bool) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = [t.encode("utf-8", "replace").split(b"\n") for t in texts_of(batch)]
        hashes = [[line_hash(x) for x in own] for own in lines]
        gone = probe.dropped(list({h for own in hashes for h in own if h is not None}))
        kept = [[x for x, h in zip(own, hs, strict=True) if h not in gone] for own, hs in zip(lines, hashes, strict=True)] if gone else lines
        return _finished(batch, lines, kept, digest)

    return arrow_map(docs.select("doc_id", "text") if digest else docs, run, _schema_of(docs, digest))


def _join_lines(docs: DataFrame, frequent: DataFrame, digest: bool) -> DataFrame:
    """The same with joins, for more frequent keys than a machine should hold: lines to keys, and dropped keys back to documents.

    Rows are known by id and text hash here, so that rows that repeat an id don't mix; a row's list of dropped keys is
    as short as its text.
    """
    row, lost = free_name(docs.columns, "row_key"), free_name(docs.columns, "lost_keys")
    row_key = F.sha2(F.to_json(F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))), 256).alias(row)

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        hi, lo, at = [], [], []
        for k, text in enumerate(texts_of(batch)):
            found = {line_hash(x) for x in text.encode("utf-8", "replace").split(b"\n")} - {None}
            hi += [h for h, _ in found]
            lo += [x for _, x in found]
            at += [k] * len(found)
        return pa.RecordBatch.from_arrays([batch.column(row).take(pa.array(at, pa.int64())), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=[row, "hi", "lo"])

    rows = arrow_map(docs.select(row_key, "text"), keys, f"{row} string, hi long, lo long").distinct()
    gone = rows.join(frequent, ["hi", "lo"], "left_semi").groupBy(row).agg(F.collect_list(F.struct("hi", "lo")).alias(lost))
    held = docs.select("doc_id", "text") if digest else docs
    held = held.select("*", row_key).join(gone, row, "left").drop(row)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = [t.encode("utf-8", "replace").split(b"\n") for t in texts_of(batch)]
        out = [{(x["hi"], x["lo"]) for x in g or []} for g in batch.column(lost).to_pylist()]
        kept = [[x for x in ls if line_hash(x) not in g] if g else ls for ls, g in zip(lines, out, strict=True)]
        return _finished(batch.drop_columns([lost]), lines, kept, digest)

    return arrow_map(held, run, _schema_of(docs, digest))


def dedup_lines(docs: DataFrame, min_docs: int = 10, digest: bool = False, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Lines whose key at least min_docs documents hold go from every document; see LineIndex.apply for the result."""
    return LineIndex(docs.sparkSession, min_docs=min_docs).insert(docs).apply(docs, broadcast_bytes, digest)
