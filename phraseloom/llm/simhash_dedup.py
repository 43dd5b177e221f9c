"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has 64 bits: bit b is set when more than half of its shingle hashes have bit b set. Two
fingerprints link when they differ in at most three bits; linked fingerprints, through any number of links, are one
component.

Search. The 64 bits are a ring of eight segments of eight bits. If two fingerprints differ in at most 3 bits, some
start of the ring has, for every length L from 1 to 8, at most floor(3 L / 8) differences in the L consecutive
segments from there: budgets 0 0 1 1 1 2 2 3. The first two segments are then equal, and of the next three at
most one differs. So each of the 8 starts gives three keys (which of the three may differ), of 32 exact bits each; two
fingerprints that link share one of these 24 keys. Pairs that meet under a key have to hold the whole chain of
budgets from that start before the full Hamming check is made.

Only distinct fingerprints take part, so copies cost nothing. A key that more than ``bucket_limit`` distinct
fingerprints share is split instead of joined: the 32 bits outside the key are eight nibbles of which at most three
may differ, and each of the 56 choices of three gives a finer key of 52 exact bits, under which at most 2^12 distinct
fingerprints exist. No candidate is dropped by that, and no group of pairs is without bound.

Components come from rounds of minimum labels over the links with pointer jumping, each round a stored table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.llm.common import WORD, arrow_map, bounded_broadcast, discard, ids_and_texts, only_ids, stored, texts_of, without_ids

SEGMENTS, WIDTH, DISTANCE = 8, 8, 3
#: Differences allowed in the first L segments of a chain, for L = 1 to 8.
BUDGETS = [DISTANCE * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
_word = re.compile(WORD.encode())
_all = (1 << 64) - 1


def shingles(text: str, words: int, seed: int = 42) -> np.ndarray:
    """The hash of each shingle of a text in its order, repeats included; of the whole sequence if it has fewer words; none without words."""
    found = _word.findall(text.encode("utf-8", "replace").lower())  # of bytes, lower() changes A-Z alone
    if not found:
        return np.array([], np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of shingle hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounds the memory that the bits of a very long text take
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; 0 if it has no word."""
    return fingerprint_of(shingles(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number; one pass over the texts, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words, seed) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(ids_and_texts(docs), run, f"doc_id {kind}, fp long")


def _mask(positions: list[int], width: int) -> int:
    return sum(((1 << width) - 1) << (width * (p % (64 // width))) for p in positions)


def _signed(value: int) -> int:
    value &= _all
    return value - (1 << 64) if value >> 63 else value


def _chain_masks() -> list[tuple[int, int, int]]:
    """(number of the key, start, mask of its 32 exact bits), three keys for each start."""
    out = []
    for start in range(SEGMENTS):
        for free in (2, 3, 4):
            exact = [start + k for k in range(5) if k != free]
            out.append((len(out), start, _mask(exact, WIDTH)))
    return out


KEYS = _chain_masks()


def _chain_holds() -> Column:
    """The whole chain of budgets from the key's start, then the Hamming check: columns a, b and start."""
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # turned so that the chain starts at bit 0; a shift by 64 is one by 0
    turned = F.expr(f"shiftrightunsigned(a ^ b, {WIDTH} * start) | shiftleft(a ^ b, 64 - {WIDTH} * start)")
    held = F.bit_count(differ) <= DISTANCE
    for n, budget in reversed(list(enumerate(BUDGETS, 1))):
        if n == SEGMENTS or BUDGETS[n] > budget:  # within a run of equal budgets the longest chain implies the others
            held = (F.bit_count(turned.bitwiseAND(F.lit(_signed((1 << (n * WIDTH)) - 1)))) <= budget) & held
    return held


def _pairs(keyed: DataFrame, by: list[str]) -> DataFrame:
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.select(*by, F.col("fp").alias("b"))
    return left.join(right, by).where(F.col("a") < F.col("b")).where(_chain_holds()).select("a", "b")


def links(fps: DataFrame, bucket_limit: int = 512) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in at most three bits."""
    keys = F.array(*[F.struct(F.lit(n).alias("key_no"), F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for n, s, m in KEYS])
    keyed = stored(fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.*"), "chains")
    sizes = keyed.groupBy("key_no", "bits").count().where("count > 1")
    sizes = stored(sizes, "chain-sizes")
    common = keyed.join(sizes.where(F.col("count") <= bucket_limit).drop("count"), ["key_no", "bits"])
    crowded = keyed.join(sizes.where(F.col("count") > bucket_limit).drop("count"), ["key_no", "bits"])
    # which nibbles lie outside the 32 exact bits of a key, and the finer masks that leave three of them free
    finer = F.lit(None).cast("array<bigint>")
    for n, _, mask in KEYS:
        nibbles = [p for p in range(16) if not (mask >> (4 * p)) & 15]
        choices = [_signed(_all & ~_mask(list(three), 4)) for three in combinations(nibbles, 3)]
        finer = F.when(F.col("key_no") == n, F.array(*[F.lit(c) for c in choices])).otherwise(finer)
    split = crowded.withColumn("mask", F.explode(finer)).withColumn("fine", F.col("fp").bitwiseAND(F.col("mask")))
    return _pairs(common, ["key_no", "bits", "start"]).unionByName(_pairs(split.drop("bits"), ["key_no", "mask", "fine", "start"])).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    A round takes the smallest label among the neighbours and then the label of that label, so a chain of n links needs
    about log n rounds. Minima are combined before each shuffle.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))), "links")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "root"), "other").select("node", "root").unionByName(labels)
        nearest = heard.groupBy("node").agg(F.min("root").alias("root"))
        jumped = nearest.alias("x").join(labels.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
        new = stored(jumped.select("node", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, bucket_limit: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    Null and empty texts have fingerprint zero, which links like any other; repeated rows each get their row; an
    empty table gives an empty result. A component's id is the smallest doc_id in it (a null id only if all are null).
    """
    own = stored(fingerprints(docs, words, seed), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), bucket_limit))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class Similar:
    """Similar documents: shingle length, least similarity of the shingle sets, its measure, and the bands of minima that find them.

    The measure is "jaccard" (shared shingles over all) or "cosine" (shared shingles over the root of the product of both
    numbers; what SimHash estimates). Of pairs at 0.8 share one of 24 bands of 3 minima: by jaccard all but 1 in 30 million, by
    cosine all but 1 in 1,300 (a jaccard similarity of 0.64, the least that 0.8 allows).
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 3
    measure: str = "jaccard"

    def __post_init__(self) -> None:
        if self.measure not in ("jaccard", "cosine"):
            raise ValueError(f"no measure {self.measure!r}")


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; of the whole sequence if it has fewer words."""
    return np.unique(shingles(text, words))


def _band_keys(hashes: np.ndarray, p: Similar) -> list[int]:
    """A number for each band, which tells bands apart: a mixture of the band's minima."""
    factors = np.random.default_rng(17).integers(1, 1 << 63, p.bands * p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), np.uint64(_all))
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[k : k + 2048, None] * factors[None, :]).min(0))
    return [xxhash.xxh64_intdigest(least[k * p.rows : (k + 1) * p.rows].tobytes(), k) - (1 << 63) for k in range(p.bands)]


def _node(hashes: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(hashes.tobytes())


def sketches(docs: DataFrame, p: Similar) -> DataFrame:
    """(doc_id, fp, node, n, bands): fingerprint, digest and size of the shingle set, and its band keys; one pass, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, nodes, sizes, bands = [], [], [], []
        for text in texts_of(batch):
            every = shingles(text, p.words)
            own = np.unique(every)
            fps.append(fingerprint_of(every))
            nodes.append(_node(own))
            sizes.append(len(own))
            bands.append(_band_keys(own, p) if len(own) else [])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "fp", "node", "n", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(ids_and_texts(docs), run, f"doc_id {kind}, fp long, node string, n long, bands array<bigint>")


def _alike(shared: Column, x: Column, y: Column, p: Similar) -> Column:
    """Whether sets of x and y members that share so many are similar enough."""
    return shared >= p.similarity * (x + y - shared) if p.measure == "jaccard" else shared >= p.similarity * F.sqrt(x * y)


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, p: Similar) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets are similar enough; only their texts are read again."""
    sizes = lambda side: sets.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("rep").alias(f"r{side}"))
    near = pairs.join(sizes("a"), "a").join(sizes("b"), "b")
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    near = stored(near.where(_alike(least, least, most, p)), "pairs")  # the smaller set at best lies in the larger
    ids = lambda side: near.select(F.col(side).alias("wanted_id"))
    wanted = stored(ids("ra").distinct().unionByName(ids("rb").distinct()).distinct(), "wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_hashes(t, p.words) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([pa.array([_node(h) for h in found]), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["node", "hashes"])

    texts = ids_and_texts(docs).join(bounded_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    held = stored(arrow_map(texts, run, "node string, hashes array<bigint>").groupBy("node").agg(F.first("hashes").alias("hashes")), "shingle-sets")
    both = near.select("a", "b").join(held.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    out = stored(both.where(_alike(shared, F.size("x"), F.size("y"), p)).select("a", "b"), "similar-pairs")
    for df in (near, wanted, held):
        discard(df)
    return out


def _simhash_edges(own: DataFrame, bucket_limit: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a fingerprint or have two that link; a node may have several, by repeats of its shingles."""
    both = stored(own.select("fp", "node").distinct(), "fingerprints")
    firsts = stored(both.groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-nodes")
    same = both.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    name = lambda fp, node: firsts.select(F.col("fp").alias(fp), F.col("first").alias(node))
    close = links(firsts.select("fp"), bucket_limit).join(name("a", "x"), "a").join(name("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return stored(same.unionByName(close).where("a <> b").distinct(), "simhash-links")


def _joined_up(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """The labels (node, label) after the pairs (a, b) are linked too; only labels that the pairs touch take part."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    edges = stored(pairs.join(of("a"), "a").join(of("b"), "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "label-links")
    if edges.isEmpty():
        return labels
    roots = components(edges).select(F.col("node").alias("label"), "root")
    return stored(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def _led(keyed: DataFrame) -> DataFrame:
    """The rows (key, band, node, weight) of keys with two nodes or more, with the key's size and leader: the node of the most weight."""
    of = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("weight")).alias("w"), F.col("node").alias("node")))["node"].alias("leader"))
    return keyed.join(of.where("size > 1"), "key")


def similar_documents(docs: DataFrame, p: Similar | None = None, bucket_limit: int = 512, direct: int = 16) -> DataFrame:
    """(doc_id, component_id): components of documents that SimHash links, or whose shingle sets are at least p.similarity alike.

    Three differing bits of a SimHash stand for a similarity far above 0.8, so that its links alone would miss most
    pairs at 0.8. Documents that share a band of minima are therefore candidates too, and are checked on their whole
    shingle sets. Only distinct shingle sets (nodes) take part.

    Candidates grow with the members of a bucket, not with their pairs. All are compared with the bucket's leader, which
    is the member with the largest buckets in all, so of a group of copies the text that they come from. Where members are left outside the
    leader's component, a bucket of at most ``direct`` members compares them with all that they aren't joined to; a
    larger one is split by the keys of two, then of four neighbouring bands, each part with a leader of its own.
    What still shares twelve minima after that and isn't joined is compared outright. Worst case: a pair in
    crowded buckets alone (both texts mostly a passage that more than ``direct`` others share, neither like any leader) is
    found only if it shares the finer keys; and m such texts with the same twelve minima make up to m * m / 2 comparisons.

    Null and empty texts are alike; a null id is an id; rows that repeat an id are searched with each of their texts.
    """
    p = p or Similar()
    own = stored(sketches(docs, p), "sketches")
    sets = stored(own.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "shingle-nodes")
    labels = _joined_up(sets.select("node", F.col("node").alias("label")), _simhash_edges(own, bucket_limit))
    members = sets.select("node", F.posexplode("bands").alias("band", "key"))
    shared = stored(members.join(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "band-members")
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighted = stored(shared.drop("size").join(weights, "node"), "band-weights")
    discard(shared)
    for width in (1, 2, 4, 0):
        if width == 1:
            led = stored(_led(weighted), "buckets")
            pairs = led.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
        else:
            # buckets in which some member isn't joined to the leader
            of = lambda node, label: labels.select(F.col("node").alias(node), F.col("label").alias(label))  # noqa: E731, B023
            named = led.join(of("node", "label"), "node").join(of("leader", "leader_label"), "leader")
            apart = named.groupBy("key").agg(F.max((F.col("label") != F.col("leader_label")).cast("int")).alias("apart")).where("apart = 1").select("key")
            open_ = stored(named.join(apart, "key", "left_semi").select("key", "band", "node", "weight", "size", "label", "leader_label"), "open-buckets")
            discard(led)
            if open_.isEmpty():
                break
            outright = open_ if not width else open_.where(F.col("size") <= direct)
            left = outright.where("label <> leader_label").select("key", F.col("node").alias("x"), F.col("label").alias("lx"))
            met = left.join(outright.select("key", F.col("node").alias("y"), F.col("label").alias("ly")), "key").where("lx <> ly")
            pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            if width:
                finer = F.xxhash64(F.slice(F.concat("bands", "bands"), F.col("band") + 1, F.lit(width)), F.col("band"))
                crowded = open_.where(F.col("size") > direct).join(sets.select("node", "bands"), "node")
                led = stored(_led(crowded.select(finer.alias("key"), "band", "node", "weight")), "buckets")
                ends = led.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
                near = ends.join(of("a", "la"), "a").join(of("b", "lb"), "b").where("la <> lb")
                pairs = pairs.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        pairs = stored(pairs.distinct(), "candidates")
        labels = _joined_up(labels, _verified(docs, sets, pairs, p))
    rooted = sets.select("node", "rep").join(labels, "node")
    smallest = rooted.groupBy("label").agg(F.min("rep").alias("component_id"))
    return own.select("doc_id", "node").join(rooted.join(smallest, "label").select("node", "component_id"), "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, p: Similar | None = None, bucket_limit: int = 512) -> DataFrame:
    """docs with one document of each component of similar_documents(): that with the smallest doc_id; columns and texts as they are.

    Of rows that repeat a kept doc_id, one stays. Texts without words are all alike.
    """
    found = stored(similar_documents(docs, p, bucket_limit).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id")), "components")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = without_ids(docs, stored(found.where(~own).select("doc_id"), "lost"))
    again = stored(found.where((F.col("n") > 1) & own).select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    return without_ids(kept, again).unionByName(only_ids(kept, again).dropDuplicates(["doc_id"]))
