"""Sharding by a k-d tree over document metadata, with shards of nearly equal bytes.

Copies of one text form a group that stays together, so the tree is built over groups: a group's weight is its bytes,
its coordinates are metadata. A node that has to make k shards is split along the dimension in which its groups spread
widest, at the place that leaves floor(k/2)/k of its bytes below. Groups with the same coordinate are told apart by a hash, so
a dimension of few values splits as evenly as any other.

The place of a weighted median comes from distributed sums: bytes by the first bits of the position, then by the next
bits within the part that holds the median. A pass returns at most nodes * 2^BITS sums, whatever the input.

Groups over 1/64 of a shard are few (at most 64 for each shard) and are placed one by one, on the side where they lie as
long as it has room; the others fill up around them. A group of more than a whole shard can't stay together: it is first cut
into parts by a hash of the id. Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.llm.common import discard, free_name, stored

#: Bits of the position that one pass resolves; a position has 12 bits of the coordinate and 24 of the hash.
BITS, COORDINATE_BITS, HASH_BITS = 12, 12, 24
POSITION_BITS = COORDINATE_BITS + HASH_BITS
#: Parts of a shard's bytes from which on a group is placed by itself.
HEAVY = 64


def default_dimensions(columns: list[str]) -> dict[str, Column]:
    """Coordinates from 0 to 1 of a documents table, of those of its metadata columns that are there."""
    found = {"size": F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 1.0) / 31}
    for name in ("lang", "source"):
        if name in columns:
            found[name] = F.coalesce(F.crc32(F.col(name).cast("string")), F.lit(0)) / float(1 << 32)
    return found


@dataclass
class Node:
    shards: tuple[int, int]  # from, to (exclusive)
    number: int
    heavy: list[dict] = field(default_factory=list)

    @property
    def count(self) -> int:
        return self.shards[1] - self.shards[0]


def _position(coordinate: Column, spread: Column) -> Column:
    """Coordinate first, hash second, as one whole number of POSITION_BITS bits."""
    top = (1 << COORDINATE_BITS) - 1
    return F.shiftleft(F.least(F.lit(top), F.greatest(F.lit(0), F.floor(coordinate * top))).cast("long"), HASH_BITS) + F.pmod(spread, F.lit(1 << HASH_BITS))


def _cut(light: DataFrame, wanted: dict[int, float]) -> dict[int, int]:
    """For each node the position up to which its light groups weigh as near to the wanted bytes as can be: columns node, position, w.

    A pass sums bytes by the next BITS bits and finds in Spark where the running sum passes what is wanted; a row for each node
    comes to the driver.
    """
    prefix, left = dict.fromkeys(wanted, 0), dict(wanted)
    running = Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most 2^BITS rows
    for shift in range(POSITION_BITS - BITS, -1, -BITS):
        # a row for each node
        asked = light.sparkSession.createDataFrame([(n, p, float(left[n])) for n, p in prefix.items()], "node int, prefix long, left double")
        inside = light.join(F.broadcast(asked), "node").where(F.shiftright("position", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("node", F.shiftright("position", shift).alias("b")).agg(F.sum("w").alias("w"), F.first("left").alias("left"))
        passed = sums.withColumn("upto", F.sum("w").over(running)).where(F.col("upto") > F.col("left"))
        found = {r["node"]: r for r in passed.groupBy("node").agg(F.min(F.struct("b", (F.col("upto") - F.col("w")).alias("below"))).alias("at")).select("node", "at.b", "at.below").collect()}
        for n in prefix:
            if n in found:
                prefix[n], left[n] = found[n]["b"], left[n] - found[n]["below"]
            else:  # all of it is wanted: the last bucket, and nothing of what follows
                prefix[n], left[n] = (prefix[n] << BITS) + (1 << BITS) - 1, float("inf")
    return {n: p if left[n] == float("inf") else p - 1 for n, p in prefix.items()}


def _sides(node: Node, name: str, weights: dict[int, float]) -> tuple[list[dict], list[dict], float]:
    """Heavy groups for the lower and upper side, in the order of their positions, and the bytes that light groups should add below."""
    lower, upper, taken, over = [], [], 0.0, 0.0
    total = weights[node.number] + sum(h["w"] for h in node.heavy)
    half = total * (node.count // 2) / node.count
    for h in sorted(node.heavy, key=lambda h: (h["dims"][name], h["h"], h["part"])):
        # below if more than half of the group fits in what is left there, else above
        if taken + h["w"] / 2 <= half and (taken + h["w"] <= half or over + h["w"] > total - half):
            lower.append(h)
            taken += h["w"]
        else:
            upper.append(h)
            over += h["w"]
    return lower, upper, min(max(0.0, half - taken), weights[node.number])


def _balanced(node: Node, weights: dict[int, float]) -> tuple[list[dict], list[dict], float]:
    """Like _sides, but heavy groups go by weight to the side with more room, so that light groups can even them out."""
    total = weights[node.number] + sum(h["w"] for h in node.heavy)
    half = total * (node.count // 2) / node.count
    lower, upper, low, high = [], [], 0.0, 0.0
    for h in sorted(node.heavy, key=lambda h: (-h["w"], h["h"], h["part"])):
        if half - low >= total - half - high:
            lower.append(h)
            low += h["w"]
        else:
            upper.append(h)
            high += h["w"]
    return lower, upper, min(max(0.0, half - low), weights[node.number])


def assign(docs: DataFrame, shards: int = 8, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard): every row of docs in one of the shards.

    size is the UTF-8 bytes of the text (0 if null) plus 1. Null and empty texts are one group. An empty table gives an
    empty result; with fewer groups than shards some shards stay empty. Rows with the same id and text (null ids count as one id)
    can't be told apart and stay together, also where that makes a shard larger.

    What the driver holds are numbers: a row for each node, and at most HEAVY groups for each shard.
    """
    spark = docs.sparkSession
    dims = dimensions or default_dimensions(docs.columns)
    text = F.coalesce("text", F.lit(""))
    base = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            *[c.cast("double").alias(f"d_{n}") for n, c in dims.items()],
        ),
        "shard-rows",
    )
    key = ["h", "text_crc32", "part"]
    whole = base.groupBy("h", "text_crc32").agg(F.sum("size").alias("w"), *[F.min(f"d_{n}").alias(f"d_{n}") for n in dims])
    whole = stored(whole, "shard-groups")
    total = whole.agg(F.sum("w")).first()[0] or 0
    share = total / shards
    # at most as many groups as shards can weigh more than a shard
    over = whole.where(F.col("w") > share).select("h", "text_crc32", F.ceil(F.col("w") * 2 * HEAVY / F.lit(max(1.0, share))).alias("cuts"))
    base = base.join(F.broadcast(over), ["h", "text_crc32"], "left")
    base = base.withColumn("part", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("cuts"))).cast("int")).drop("cuts")
    if over.isEmpty():
        groups = whole.withColumn("part", F.lit(0))
    else:
        groups = stored(base.groupBy(*key).agg(F.sum("size").alias("w"), *[F.min(f"d_{n}").alias(f"d_{n}") for n in dims]), "shard-groups")
    heavy_from = share / HEAVY
    # at most HEAVY * shards groups weigh that much
    heavy = [r.asDict() | {"dims": {n: r[f"d_{n}"] for n in dims}} for r in groups.where(F.col("w") > heavy_from).collect()] if total else []
    light = groups.where(F.col("w") <= heavy_from)
    spread = F.xxhash64("h", "text_crc32", "part")

    nodes = [Node((0, shards), 0, heavy)]
    placed: list[dict] = []
    where = light.withColumn("node", F.lit(0))
    final: dict[int, int] = {}
    number = 0
    while nodes:
        open_nodes = []
        for n in nodes:
            if n.count == 1:
                final[n.number] = n.shards[0]
                placed += [{"h": h["h"], "text_crc32": h["text_crc32"], "part": h["part"], "shard": n.shards[0]} for h in n.heavy]
            else:
                open_nodes.append(n)
        if not open_nodes:
            break
        # one pass for the spread of every open node: a row for each node
        asked = spark.createDataFrame([(n.number,) for n in open_nodes], "node int")
        spans = {r["node"]: r for r in where.join(F.broadcast(asked), "node").groupBy("node").agg(F.sum("w").alias("w"), *[(F.max(f"d_{n}") - F.min(f"d_{n}")).alias(f"s_{n}") for n in dims]).collect()}
        weights = {n.number: float(spans[n.number]["w"]) if n.number in spans else 0.0 for n in open_nodes}
        widest = {n.number: max(dims, key=lambda d: (spans[n.number][f"s_{d}"] or 0.0) if n.number in spans else 0.0) for n in open_nodes}
        sides = {n.number: _best(n, widest[n.number], weights) for n in open_nodes}
        # a row for each node at most, here and below
        split = spark.createDataFrame([(n, list(dims).index(d)) for n, d in widest.items()], "node int, along int")
        coordinate = F.get(F.array(*[F.col(f"d_{n}") for n in dims]), F.col("along"))
        at = where.join(F.broadcast(split), "node").withColumn("position", _position(coordinate, spread))
        cuts = _cut(at, {n: s[2] for n, s in sides.items()})
        below = []
        for n in open_nodes:
            half = n.count // 2
            below += [Node((n.shards[0], n.shards[0] + half), number + 1, sides[n.number][0]), Node((n.shards[0] + half, n.shards[1]), number + 2, sides[n.number][1])]
            cuts[n.number] = (cuts[n.number], number + 1, number + 2)
            number += 2
        moves = spark.createDataFrame([(n, list(dims).index(widest[n]), *c) for n, c in cuts.items()], "node int, along int, cut long, low int, high int")
        # nodes that are shards already keep their number
        moved = where.join(F.broadcast(moves), "node", "left").withColumn("position", _position(coordinate, spread))
        new = F.when(F.col("cut").isNull(), F.col("node")).when(F.col("position") <= F.col("cut"), F.col("low")).otherwise(F.col("high"))
        after = stored(moved.select(*[c for c in where.columns if c != "node"], new.alias("node")), "shard-nodes")
        discard(where)
        where = after
        nodes = below
    names = spark.createDataFrame(list(final.items()) or [(0, 0)], "node int, shard int")
    assigned = where.join(F.broadcast(names), "node").select(*key, "shard")
    # rows of heavy groups find their shard without a shuffle, so no task gets more than 1/HEAVY of a shard of one group
    hot = spark.createDataFrame([tuple(p[k] for k in (*key, "shard")) for p in placed], "h long, text_crc32 long, part int, hot int")
    split = base.join(F.broadcast(hot), key, "left")
    light_rows = split.where(F.col("hot").isNull()).drop("hot").join(assigned, key)
    return split.where(F.col("hot").isNotNull()).withColumnRenamed("hot", "shard").select(own := ["doc_id", "size", "text_crc32", "shard"]).unionByName(light_rows.select(own))


def _best(node: Node, name: str, weights: dict[int, float]) -> tuple[list[dict], list[dict], float]:
    """Heavy groups where they lie if that can be evened out, else spread by weight."""
    first = _sides(node, name, weights)
    total = weights[node.number] + sum(h["w"] for h in node.heavy)
    half = total * (node.count // 2) / node.count
    off = lambda s: abs(sum(h["w"] for h in s[0]) + s[2] - half)
    return first if off(first) <= 1 else min(first, _balanced(node, weights), key=off)


def with_slots(assigned: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """slot: the number of each row in its shard, gapless from 0.

    Rows are numbered within hash parts of a shard, which hold about rows_per_part rows each, and a part starts where the
    parts before it end; no task numbers a whole shard.
    """
    assigned = stored(assigned, "shards")
    shards = assigned.agg(F.count("*").alias("n"), F.count_distinct("shard").alias("k")).first()
    parts = max(1, -(-shards["n"] // max(1, shards["k"] * rows_per_part)))
    cut = assigned.withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    numbered = cut.withColumn("k", F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32")) - 1)
    return numbered.join(starts, ["shard", "piece"]).withColumn("slot", (F.col("start") + F.col("k")).cast("long")).drop("piece", "k", "start")


def shard_by_bytes(docs: DataFrame, shards: int = 8, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """assign() with slots, in the columns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law doesn't grow)."""
    own = with_slots(assign(docs, shards, dimensions))
    return own.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, target_bytes: int = 256 << 20, dimensions: dict[str, Column] | None = None) -> int:
    """Write docs as one folder for each shard, with as many shards as target_bytes asks for; returns their number.

    The folders are named by a column ``shard``, or ``shard_1`` and so on where docs has a column of that name. Rows are
    matched to shards by id and text, so a row that repeats exactly is written once for each of its rows.
    """
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    shards = max(1, -(-total // target_bytes))
    text, taken = F.coalesce("text", F.lit("")), list(docs.columns)
    name = {}
    for wanted in ("shard", "other_id", "other_size", "other_crc"):
        name[wanted] = free_name(taken, wanted)
        taken.append(name[wanted])
    found = assign(docs, shards, dimensions).distinct().toDF(name["other_id"], name["other_size"], name["other_crc"], name["shard"])
    same = F.col("doc_id").eqNullSafe(F.col(name["other_id"])) & ((F.octet_length(text) + 1) == F.col(name["other_size"])) & (F.crc32(text) == F.col(name["other_crc"]))
    docs.join(found, same).drop(name["other_id"], name["other_size"], name["other_crc"]).write.partitionBy(name["shard"]).parquet(path)
    return shards
