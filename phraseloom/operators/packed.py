"""Counts of n-grams from packed hashes, for what would be too much to shuffle as text.

Passes over the tokens and over what they send, each in Arrow batches with whole-array arithmetic:

* ``frequent_bits``: 42 bits of the hash of every n-gram meet in sorted pieces of four bytes each. Of what occurs often
  enough a bit map is made, with 64 bits for each such hash up to BITS_MOST in all. Hashes that collide only set bits too many.
* ``contexts``: each place whose n-gram has its bit goes on as long as the next n-gram has, up to a greatest length. Equal contexts
  of a part of a task are one row, with the documents of each prefix, so that copies and common lines are not sent one by one.
  The rows of a part that go to the same place are sent as one compressed piece. Where over a QUARTER of all places go on, their tokens
  are stored (``covered``), and contexts are sent and counted in several rounds, each for the n-grams with some hashes only.
* ``merged``: the pieces are opened, and all prefixes of their contexts are counted at once along the sorted contexts. A context comes
  with the token before it, so that extensions to both sides are known there and phrases that a rule drops are never stored.

Nothing is dropped: a place is left out only if its n-gram occurs less often than asked for. Which contexts of a part are
equal is told by 64-bit hashes; across parts by their tokens. An empty token is a break that no n-gram holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.plans.tables import settle

#: Bits of a hash that tell its partition, and that are sent.
PART_BITS, SENT_BITS = 12, 32
#: Bits of a bit map: for each hash (a power of two), and at least and at most in all (as powers of two; 64 MB).
BITS_EACH, BITS_LEAST, BITS_MOST = 6, PART_BITS + 3, 29
#: N-grams in a sorted run, bytes of a part of a task (tokens of contexts and places), bytes hashed at once, rows of an Arrow batch.
RUN_GRAMS, PART_BYTES, HASH_BYTES, ROWS = 1 << 22, 24 << 20, 1 << 20, 500
#: Bytes that a place of a part of a task counts for, beside its tokens; bytes of tokens in a stored piece of them.
PLACE_BYTES, STORED_BYTES = 24, 1 << 18
#: Share of all places whose contexts are on disk at once: with all of them frequent, there are as many rounds as it goes into 1.
QUARTER = 0.25
#: Pieces of contexts: least and greatest number (as powers of two), and bits of the bit map for each (by size, some 80,000 rows at 1 GB).
PIECES_LEAST, PIECES_MOST, PIECE_BITS = 8, 11, 18
#: Texts made at once.
TEXTS = 1 << 16

_base = 0x9E3779B97F4A7C15
_byte = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_base, pow(_base, -1, 1 << 64)))


def token_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the tokens data[at[k]:at[k + 1]]: polynomials of their bytes from running sums, then mixed."""
    out = np.empty(len(at) - 1, np.uint64)
    k = 0
    while k < len(out):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + HASH_BYTES, "right")) - 1)
        own = data[at[k] : at[stop]]
        power, inverse = _powers(max(HASH_BYTES, 1 << int(len(own)).bit_length()))
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_byte[own] * power[: len(own)], out=sums[1:])
        s, e = at[k:stop] - at[k], at[k + 1 : stop + 1] - at[k]
        out[k:stop] = _mix((sums[e] - sums[s]) * inverse[s])
        k = stop
    return out


class _Tokens:
    """The tokens of a batch: bytes, offsets, hashes, and the document of each."""

    def __init__(self, column: pa.ListArray) -> None:
        bounds = np.asarray(column.offsets).astype(np.int64)
        own = column.values.slice(bounds[0], bounds[-1] - bounds[0])
        kind = np.int64 if pa.types.is_large_string(own.type) else np.int32
        n = len(own)
        at = np.frombuffer(own.buffers()[1], kind)[own.offset : own.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(own.buffers()[2], np.uint8)[at[0] : at[-1]] if n and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self._of(np.diff(bounds))

    def _of(self, sizes: np.ndarray) -> None:
        self.docs = len(sizes)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.hash = token_hashes(self.data, self.at)

    @classmethod
    def stored(cls, piece: bytes) -> tuple[_Tokens, np.ndarray]:
        """The tokens of a piece that covered() stored, and the length of the context from each place."""
        raw, out = _opened(piece), cls.__new__(cls)
        docs, n = raw[:16].view(np.int64).tolist()
        in_doc, sizes, length = np.split(raw[16 : 16 + 4 * (docs + 2 * n)].view(np.int32), [docs, docs + n])
        out.data, out.at = raw[16 + 4 * (docs + 2 * n) :], np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        out._of(in_doc)
        return out, length

    def lengths(self, shortest: int, longest: int, bits: np.ndarray, width: int) -> np.ndarray:
        """How long the context from each place is: 0 where the n-gram there has no bit, else as far as the next ones have theirs."""
        seen = self.marked(shortest, bits, width)[1]
        place, gaps = np.flatnonzero(seen), np.flatnonzero(~np.r_[seen, False])
        run = np.minimum(gaps[np.searchsorted(gaps, place)] - place, longest - shortest + 1)
        out = np.zeros(len(self.hash), np.int32)
        out[place] = np.minimum(run + shortest - 1, np.searchsorted(self.doc, self.doc[place], "right") - place)
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n tokens from each place, and whether they are n tokens of one document without a break."""
        size = max(0, len(self.hash) - n + 1)
        found = self.hash[:size]
        for j in range(1, n):
            found = _longer(found, self.hash[j : j + size])
        whole = self.doc[:size] == self.doc[n - 1 : n - 1 + size]
        breaks = np.cumsum(np.r_[0, np.diff(self.at) == 0])
        return found, whole & (breaks[n : n + size] == breaks[:size])

    def marked(self, n: int, bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n tokens from each place, and whether it has its bit in a bit map of 2 ** width bits."""
        gram, whole = self.grams(n)
        index = gram >> np.uint64(64 - width)
        return gram, whole & ((bits[index >> np.uint64(3)] >> (7 - (index & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


def _longer(gram: np.ndarray, token: np.ndarray) -> np.ndarray:
    return _mix(gram * np.uint64(_base) + token)


class _Covered:
    """The contexts of a batch: place, document, length, hashes of the prefixes of each length, whether the context a place
    before goes on to this one (lead) and the hash of that token, and the tokens that any of them holds. Of several rounds, those of one."""

    def __init__(self, t: _Tokens, all_lengths: np.ndarray, shortest: int, longest: int, left: bool = False, rounds: int = 1, own: int = 0) -> None:
        gram, place = t.grams(shortest)[0], np.flatnonzero(all_lengths)
        if rounds > 1:
            place = place[gram[place] % np.uint64(rounds) == own]
        self.docs, self.doc, length = t.docs, t.doc[place], all_lengths[place]
        prefix = gram[place]
        self.prefixes = [prefix]
        for n in range(shortest + 1, longest + 1):
            has, before = length >= n, length >= n - 1
            prefix = _longer(prefix[has[before]], t.hash[place[has] + n - 1])
            self.prefixes.append(prefix)
        before = np.maximum(place - 1, 0)
        self.lead = (place > 0) & (all_lengths[before] > shortest) & left
        self.before = np.where(self.lead, t.hash[before], np.uint64(0))
        depth = np.bincount(place - self.lead, minlength=len(t.hash) + 1) - np.bincount(place + length, minlength=len(t.hash) + 1)
        held, sizes = np.cumsum(depth[:-1]) > 0, np.diff(t.at)
        self.data = t.data[np.repeat(held, sizes)]
        self.at = np.r_[0, np.cumsum(sizes[held])]
        self.place, self.length = (np.cumsum(held) - 1)[place], length

    @property
    def size(self) -> int:
        return len(self.data) + PLACE_BYTES * len(self.place)

    @classmethod
    def of(cls, several: list[_Covered]) -> _Covered:
        """All of them; the list is emptied meanwhile."""
        out = cls.__new__(cls)
        before = lambda sizes: np.cumsum([0, *sizes])
        starts, tokens, docs = before(len(x.data) for x in several), before(len(x.at) - 1 for x in several), before(x.docs for x in several)
        out.data = np.concatenate([x.data for x in several])
        out.at = np.concatenate([x.at[:-1] + b for x, b in zip(several, starts, strict=False)] + [starts[-1:]])
        out.place = np.concatenate([x.place + b for x, b in zip(several, tokens, strict=False)])
        out.docs, out.doc = int(docs[-1]), np.concatenate([x.doc + np.int32(b) for x, b in zip(several, docs, strict=False)])
        out.length, out.lead, out.before = (np.concatenate([getattr(x, k) for x in several]) for k in ("length", "lead", "before"))
        out.prefixes = [np.concatenate(x) for x in zip(*(x.prefixes for x in several), strict=True)]
        several.clear()
        return out


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; Spark reads the number of rows of a batch from the session when the query runs, so it is set there and stays."""
    root, held = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(":"):  # workers import this package from where the driver has it
        held["PYTHONPATH"] = ":".join(filter(None, [root, held.get("PYTHONPATH", "")]))
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return df.mapInArrow(function, schema)


def _pieces(grams: list[np.ndarray], least: int) -> pa.RecordBatch:
    """(part, hashes): the sorted hashes by partition; none is needed more than ``least`` times."""
    keys = np.sort(np.concatenate(grams) >> np.uint64(64 - PART_BITS - SENT_BITS))
    if len(keys) > least:
        keys = keys[np.r_[np.ones(least, bool), keys[least:] != keys[:-least]]]
    cuts = np.searchsorted(keys, np.arange((1 << PART_BITS) + 1, dtype=np.uint64) << np.uint64(SENT_BITS))
    sent = keys.astype(np.uint32)
    parts = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([sent[cuts[p] : cuts[p + 1]].tobytes() for p in parts], pa.binary())], names=["part", "hashes"])


def frequent_bits(tokens: DataFrame, n: int, least: int) -> tuple[np.ndarray, float]:
    """A bit map of 2 ** k bits, packed: the first k bits of the hash of each n-gram that occurs ``least`` times are set.

    And about which share of all places have such an n-gram: of those that were sent.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            found, whole = _Tokens(batch.column(0)).grams(n)
            held.append(found[whole])
            size += len(held[-1])
            if size >= RUN_GRAMS:
                yield _pieces(held, least)
                held, size = [], 0
        if size:
            yield _pieces(held, least)

    def often(part: int, held: list[bytes]) -> pa.RecordBatch:
        keys, times = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
        enough = keys[times >= least]
        numbers = (len(enough), int(times[times >= least].sum()), int(times.sum()))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in numbers), pa.array([enough.tobytes()], pa.binary())], names=["part", "n", "often", "sent", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and held:
                    yield often(part, held)
                    held = []
                part = p
                held.append(h)
        if held:
            yield often(part, held)

    sent = arrow(tokens.select("tokens"), send, "part int, hashes binary")
    found = settle(arrow(sent.repartition("part").sortWithinPartitions("part"), count, "part int, n long, often long, sent long, hashes binary"), "frequent-hashes")
    total = found.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "often", "sent"))).first()
    return bit_map(found.where("n > 0"), "hashes", int(total["n"])), total["often"] / max(1, total["sent"])


def bit_map(found: DataFrame, column: str, total: int) -> np.ndarray:
    """A bit map of 2 ** k bits, packed, for about this many hashes: found has their next SENT_BITS bits by part."""
    bits = min(BITS_MOST, max(BITS_LEAST, total.bit_length() + BITS_EACH))
    own = 1 << (bits - PART_BITS)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = []
            for h in batch.column("hashes").to_pylist():
                flags = np.zeros(own, bool)
                flags[np.frombuffer(h, np.uint32) >> np.uint32(SENT_BITS - (bits - PART_BITS))] = True
                slices.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(slices, pa.binary())], names=["part", "slice"])

    out = np.zeros((1 << PART_BITS, own // 8), np.uint8)
    made = arrow(found.select("part", F.col(column).alias("hashes")), mapped, "part int, slice binary").toArrow()
    for part, piece in zip(made.column("part").to_pylist(), made.column("slice"), strict=True):
        out[part] = np.frombuffer(piece.as_buffer(), np.uint8)
    return out.reshape(-1)


def _closed(arrays: list[np.ndarray]) -> bytes:
    raw = b"".join([x.tobytes() for x in arrays])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(piece: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(piece[8:], int.from_bytes(piece[:8], "little"), codec="zstd", asbytes=True), np.uint8)


def _packed(texts: list[np.ndarray], *numbers: np.ndarray) -> bytes:
    """A compressed piece: how many of each of these numbers, the numbers, and texts, each token with a space after it."""
    return _closed([np.array([len(x) for x in numbers], np.int64), *(x.astype(np.int32) for x in numbers), *texts])


def _unpacked(piece: bytes) -> list[np.ndarray]:
    """length, occ, lead, dfs, dfs with the token before, texts."""
    raw = _opened(piece)
    ends = np.cumsum(raw[:40].view(np.int64)).tolist()
    return [*np.split(raw[40 : 40 + 4 * ends[-1]].view(np.int32), ends[:-1]), raw[40 + 4 * ends[-1] :]]


def rounds(share: float) -> int:
    """In how many rounds contexts are sent, for a share of places that have one."""
    return max(1, int(np.ceil(share / QUARTER)))


def covered(tokens: DataFrame, shortest: int, longest: int, bits: np.ndarray) -> DataFrame:
    """(piece), stored: compressed tokens of all contexts, for contexts() to read in each round without the bit map. Other tokens aren't needed."""
    width = int(len(bits) * 8).bit_length() - 1

    def piece(held: list[_Covered], lengths: list[np.ndarray]) -> pa.RecordBatch:
        t = _Covered.of(held)
        length = np.zeros(len(t.at) - 1, np.int32)
        length[t.place] = np.concatenate(lengths)
        # a token is of the document of the last place before it, for each begins with one
        first = np.flatnonzero(np.r_[True, t.doc[1:] != t.doc[:-1]])
        in_doc = np.diff(np.r_[t.place[first], len(length)])
        raw = _closed([np.array([len(in_doc), len(length)], np.int64), in_doc.astype(np.int32), np.diff(t.at).astype(np.int32), length, t.data])
        return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, at = batch.column(0), 0
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            while at < len(column):  # some documents at a time
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + STORED_BYTES // 8, "right")))
                t = _Tokens(column.slice(at, stop - at))
                own = _Covered(t, t.lengths(shortest, longest, bits, width), shortest, shortest)
                at = stop
                if len(own.place):
                    yield piece([own], [own.length])

    return settle(arrow(tokens.select("tokens"), run, "piece binary"), "covered")


def contexts(tokens: DataFrame, shortest: int, longest: int, bits: np.ndarray, left: bool = False, rounds: int = 1, own_round: int = 0) -> DataFrame:
    """(part, piece): contexts of shortest to longest tokens, by the hash of the first ``shortest`` of them.

    A row of a piece stands for occ places of one part of a task. A prefix of n tokens lies in as many documents as the n-th of
    its dfs, summed over all rows that begin with it. Each row of tokens has to be a document of its own. With ``left`` a row also has
    the token before it, and in how many documents each prefix but the longest has that token before it. In several rounds tokens are what covered() stored.
    """
    width = int(len(bits) * 8).bit_length() - 1
    pieces = min(max(width - PIECE_BITS, PIECES_LEAST), PIECES_MOST)
    bits = bits if rounds == 1 else None

    def made(t: _Covered) -> pa.RecordBatch | None:
        if not len(t.place):
            return None
        gram, length = t.prefixes[0], t.length
        own, counted = gram.copy(), []

        def count(n: int, kind: int, prefix: np.ndarray, has: np.ndarray) -> None:
            """The number of documents of each prefix goes to the first place with it."""
            if len(has):
                order = np.argsort(prefix, kind="stable")  # by document within a prefix, since places are
                v, d = prefix[order], t.doc[has[order]]
                new = np.r_[True, v[1:] != v[:-1]]
                starts = np.flatnonzero(new)
                counted.append((kind, n - shortest, has[order[starts]], np.add.reduceat((new | np.r_[True, d[1:] != d[:-1]]).astype(np.int32), starts)))

        for n, prefix in enumerate(t.prefixes, shortest):
            has = np.flatnonzero(length >= n)
            own[has] = prefix
            count(n, 0, prefix, has)
            if left and n < longest:
                led = np.flatnonzero(t.lead[has])
                count(n, 1, _longer(prefix[led], t.before[has[led]]), has[led])
        own = _longer(_longer(own, length.astype(np.uint64)), t.before)
        _, first, row, occ = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
        # by the first n-gram, so that what contexts share lies together and compresses
        order = np.argsort(gram[first], kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        first, occ, row = first[order], occ[order], rank[row]
        dfs = np.zeros((2, len(first), longest - shortest + 1), np.int32)
        for kind, n, at, df in counted:
            dfs[kind, :, n] += np.bincount(row[at], df, len(first)).astype(np.int32)
        lead = t.lead[first].astype(np.int64)
        place, length = t.place[first] - lead, length[first]
        part = (gram[first] >> np.uint64(64 - pieces)).astype(np.int64)
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        held = np.arange(dfs.shape[2]) < (length - shortest + 1)[:, None]
        led = held & (lead > 0)[:, None] & (np.arange(dfs.shape[2]) < longest - shortest)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            texts = [_spaced(t, place[i : min(i + TEXTS, b)], (length + lead)[i : min(i + TEXTS, b)])[0] for i in range(a, b, TEXTS)]
            out.append(_packed(texts, length[a:b], occ[a:b], lead[a:b], dfs[0, a:b][held[a:b]], dfs[1, a:b][led[a:b]]))
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), pa.array(out, pa.binary())], names=["part", "piece"])

    def several(batch: pa.RecordBatch) -> Iterator[tuple[_Tokens, np.ndarray]]:
        if rounds > 1:
            yield from (_Tokens.stored(x.as_buffer()) for x in batch.column(0))
        else:
            t = _Tokens(batch.column(0))
            yield t, t.lengths(shortest, longest, bits, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for t, lengths in several(batch):
                held.append(_Covered(t, lengths, shortest, longest, left, rounds, own_round))
                size += held[-1].size
                if size >= PART_BYTES:
                    out, size = made(_Covered.of(held)), 0
                    if out is not None:
                        yield out
        if held and (out := made(_Covered.of(held))) is not None:
            yield out

    return arrow(tokens if rounds > 1 else tokens.select("tokens"), run, "part int, piece binary")


def _prefixes(pieces: list[bytes], shortest: int, longest: int, least: int, by: str, rule: str) -> Iterator[pa.RecordBatch]:
    """The frequent prefixes of the contexts of one part that the rule keeps."""
    length, occ, lead, dfs, led_dfs, data = (np.concatenate(x) for x in zip(*map(_unpacked, pieces), strict=True))
    stops = np.flatnonzero(data == 32) + 1
    if len(stops) != length.sum() + lead.sum():
        raise ValueError("a token holds a space")
    at = np.r_[0, stops]
    token = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
    begin = np.cumsum(length + lead, dtype=np.int64) - length
    before = np.where(lead > 0, token[begin - lead], -1)
    # a row for each context, -1 where it has ended: then contexts with the same prefix lie side by side, whatever its length
    ids = np.full((longest, len(length)), -1, np.int32)
    for n in range(longest):
        has = np.flatnonzero(length > n)
        ids[n, has] = token[begin[has] + n]
    counts, led_counts = (np.zeros((longest - shortest + 1, len(length)), np.int32) for _ in range(2))
    for out, own, numbers in ((counts, length - shortest + 1, dfs), (led_counts, (np.minimum(length, longest - 1) - shortest + 1) * lead, led_dfs)):
        base = np.cumsum(own, dtype=np.int64) - own
        for n in range(longest - shortest + 1):
            has = np.flatnonzero(own > n)
            out[n, has] = numbers[base[has] + n]
    order = np.lexsort(ids[::-1])
    ids, counts, led_counts, occ = ids[:, order], counts[:, order], led_counts[:, order], occ[order].astype(np.int64)
    begin, length, before = begin[order], length[order], before[order]
    new = np.zeros((longest, len(order)), bool)
    new[:, 0] = True
    for n in range(longest):
        new[n, 1:] = ids[n, 1:] != ids[n, :-1]
        if n:
            new[n] |= new[n - 1]
    goes = lambda best, weight: (best == weight) if rule.endswith("closed") else best > 0
    longer = weights = None
    for n in range(longest, shortest - 1, -1):
        starts = np.flatnonzero(new[n - 1])
        df, all_occ = np.add.reduceat(counts[n - shortest], starts, dtype=np.int64), np.add.reduceat(occ, starts)
        weight = np.where(length[starts] >= n, df if by == "df" else all_occ, 0)
        best = np.zeros(len(starts), np.int64) if longer is None else np.maximum.reduceat(weights, np.searchsorted(longer, starts))
        weight[weight < least] = 0
        longer, weights = starts, weight
        found = np.flatnonzero(weight)
        if rule:
            found = found[~goes(best[found], weight[found])] if n < longest else found[:0]
            if not rule.startswith("right_") and len(found):
                found = found[~goes(_best_before(starts, found, before, led_counts[n - shortest] if by == "df" else occ, least), weight[found])]
        for i in range(0, len(found), TEXTS):
            own = found[i : i + TEXTS]
            a = begin[starts[own]]
            text = _text(*_sliced(data, at[a], at[a + n] - 1))
            yield pa.RecordBatch.from_arrays([text, pa.array(np.full(len(own), n, np.int64)), pa.array(df[own]), pa.array(all_occ[own])], names=["phrase", "length", "df", "occ"])


def _best_before(starts: np.ndarray, found: np.ndarray, before: np.ndarray, numbers: np.ndarray, least: int) -> np.ndarray:
    """The best support of found groups of rows (by where all groups start) with one token before them, 0 if none has enough."""
    sizes = np.diff(np.r_[starts, len(before)])[found]
    group = np.repeat(np.arange(len(found)), sizes)
    rows = np.arange(len(group)) + np.repeat(starts[found] - (np.cumsum(sizes) - sizes), sizes)
    led = before[rows] >= 0
    group, rows = group[led], rows[led]
    out = np.zeros(len(found), np.int64)
    if len(rows):
        key = group * (int(before.max()) + 1) + before[rows]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        total = np.add.reduceat(numbers[rows[order]], first, dtype=np.int64)
        total[total < least] = 0
        np.maximum.at(out, group[order[first]], total)
    return out


def merged(found: DataFrame, shortest: int, longest: int, least: int, by: str, rule: str = "") -> DataFrame:
    """(phrase, length, df, occ) of the prefixes of contexts with enough support, by "df" or "occ".

    A rule keeps those shorter than the longest that aren't extended by one token: closed drops a phrase if an extension to either side
    has the same support, maximal if one has enough; right_closed and right_maximal look to the right alone.
    The contexts of a part are held at once: those of one n-gram of the shortest length at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and held:
                    yield from _prefixes(held, shortest, longest, least, by, rule)
                    held = []
                part = p
                held.append(piece)
        if held:
            yield from _prefixes(held, shortest, longest, least, by, rule)

    return arrow(found.repartition("part").sortWithinPartitions("part"), run, "phrase string, length long, df long, occ long")


def places(tokens: DataFrame, n: int, bits: np.ndarray) -> DataFrame:
    """(gram, doc_id, pos, prev) of the places whose n-gram has its bit; prev is the token before, null at a start."""
    width = int(len(bits) * 8).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _Tokens(batch.column("tokens"))
            place = np.flatnonzero(t.marked(n, bits, width)[1])
            if not len(place):
                continue
            doc = t.doc[place]
            pos = place - np.searchsorted(t.doc, doc)
            grams, before = _text(*_joined(t, place, np.full(len(place), n))), place[pos > 0] - 1
            prev = _text(*_joined(t, before, np.ones(len(before), np.int64))) if len(before) else pa.array([], pa.string())
            index = pa.array(np.cumsum(pos > 0) - 1, pa.int64(), mask=pos == 0)
            yield pa.RecordBatch.from_arrays([grams, batch.column("doc_id").take(pa.array(doc)), pa.array(pos, pa.int32()), prev.take(index)], names=["gram", "doc_id", "pos", "prev"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return arrow(tokens.select("doc_id", "tokens"), run, f"gram string, doc_id {kind}, pos int, prev string")


def _text(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def _sliced(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes data[starts[k]:stops[k]] one after the other, and their bounds."""
    bounds = np.r_[0, np.cumsum(stops - starts)]
    return data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], stops - starts)], bounds


def _spaced(t: _Tokens | _Covered, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of length[k] tokens from place[k], a space after each token, and where each text ends."""
    ends = np.cumsum(length)
    token = np.arange(ends[-1]) - np.repeat(ends - length - place, length)
    sizes = t.at[token + 1] - t.at[token] + 1  # with the space after it
    after = np.cumsum(sizes)
    out = np.full(after[-1], 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[after - 1] = False
    source = np.arange(len(out)) - np.repeat(after - sizes - t.at[token], sizes)
    out[inside] = t.data[source[inside]]
    return out, after[ends - 1]


def _joined(t: _Tokens, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts of length[k] tokens from place[k], joined by spaces."""
    out, ends = _spaced(t, place, length)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False  # the last space of each text goes
    return out[inside], np.r_[0, ends - np.arange(1, len(ends) + 1)]
