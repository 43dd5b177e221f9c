"""Benchmark decontamination by template windows.

Texts become templates: numbers, units after numbers, and names are replaced by typed placeholders, all else is
lower-cased and freed of punctuation. A capitalised word that begins a sentence or line may be a name or not and is
looked up both ways. Windows of eight template words of each document are hash-joined with those of
the benchmark items, so a question that comes back with other numbers or names still meets its item. Where a matched
stretch has placeholders, slots are compared: along one alignment of document and item each value of the item has to
stand for one value of the document, and one name of the document for one name of the item. Windows over a changed slot
that breaks this don't count; the others do, and a slot that kept its value breaks nothing.

At least half of a template window has to be plain words. The other windows of an item, stretches of names or numbers, are
looked up by their words as they are. A document holds an item if consistent template windows cover ``min_windows`` places of
it (or all that it has, if fewer), or if windows of both kinds do.

Few documents hold anything of a benchmark, so a cheap look finds those that can: each needed window of an item has a
stretch of words that no placeholder can stand for (firm words), and any seven words in a row of a document hold four that
start at a multiple of four. The hashes of a document's words by fours, from every fourth, second or each place as the shortest
stretch asks for, are joined with those of the stretches. Where a window's stretches are all shorter than four, a document
has to have each two words in a row of all its stretches (or all single words). Only documents that meet a window like this are searched window by
window. Nothing is lost by that: with a window without firm words all documents are searched.

Everything is DataFrame operations. Benchmark windows are broadcast only below a checked number of bytes; beyond it the same
join is a shuffle join on the hash. A window that k items share makes k rows for each document that has it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.llm.common import bounded_broadcast, stored, without_ids

#: What counts as a number word and, after a number, as a unit.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen")
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degrees", "mph", "kmh", "watt", "watts", "volt", "volts")
#: Window length in words, and the fewest words of an item that can match.
WINDOW, LEAST_WORDS = 8, 4
#: Where a number and its unit are written as one word.
UNIT_JOINT = rf"(?<=\p{{N}})(?=(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}]))"


@dataclass(frozen=True)
class Rule:
    window: int = WINDOW
    min_windows: int = 3


def with_words(df: DataFrame, *keep: str) -> DataFrame:
    """The columns keep and w, array<struct<t, v, n>> of column text: template word and value of each word.

    t is the placeholder of a slot and equals v otherwise; n says that a plain word may be a name, since it begins a
    sentence or line with a capital. Each step is a column of its own: an expression inside a lambda would be worked
    out anew for every word.
    """
    # line ends are words until the last step, since the first word of a line isn't taken for a name
    text = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" \n ")), f"(?i){UNIT_JOINT}", " ")
    raw = F.filter(F.split(text, r"[\x20\x09\x0B-\x0D]+"), lambda w: w != "")
    step = df.select(*keep, raw.alias("raw"))
    bare = F.transform("raw", lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    before = F.concat(F.array(F.lit("\n")), F.col("raw"))  # one longer; its last element meets no word
    step = step.select(*keep, bare.alias("b"), before.alias("p"))
    step = step.select(*keep, F.arrays_zip(F.col("b"), F.transform("b", F.lower).alias("v"), F.col("p")).alias("zipped"))

    def kind(x: Column) -> Column:
        b, v, p = x["b"], x["v"], x["p"]
        number = b.rlike(r"^\p{N}") | v.isin(*NUMBER_WORDS)
        unit = v.isin(*UNITS) & p.rlike(r"^[^\p{L}]*\p{N}[^\p{L}]*$")
        begins = p.rlike(r"(?:[.!?:;\n]|[.!?]['\")\]]+)$")
        name = F.when(begins, F.lit("n")).otherwise(F.lit("<p>"))
        return F.struct(F.when(number, F.lit("<n>")).when(unit, F.lit("<u>")).when(b.rlike(r"^\p{Lu}\p{Ll}"), name).alias("k"), v.alias("v"))

    step = step.select(*keep, F.transform(F.filter("zipped", lambda x: x["b"].isNotNull() & (x["b"] != "")), kind).alias("kinds"))
    word = lambda x: F.struct(F.when(x["k"] != "n", x["k"]).otherwise(x["v"]).alias("t"), x["v"].alias("v"), F.coalesce(x["k"] == "n", F.lit(False)).alias("n"))
    return step.select(*keep, F.transform("kinds", word).alias("w"))


def _windows(words: DataFrame, lengths: list[int], exact: bool, *keep: str) -> DataFrame:
    """(keep, pos, hash): every window of the template words of each of the lengths, in each form that its words can have.

    A word that may be a name is a plain word and a placeholder. With exact, there are also windows of the words as they
    are, where these differ.
    """
    columns = {
        "t": F.transform("w", lambda s: F.xxhash64(s["t"])),
        "p": F.transform("w", lambda s: F.xxhash64(F.when(s["n"], F.lit("<p>")).otherwise(s["t"]))),
        "n": F.transform("w", lambda s: s["n"]),
    } | ({"v": F.transform("w", lambda s: F.xxhash64(s["v"]))} if exact else {})
    step = words.select(*keep, *[c.alias(name) for name, c in columns.items()])
    hashes = []
    for n in lengths:
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - (n - 1))).otherwise(F.array().cast("array<int>"))
        hashes.append(F.transform(starts, lambda i, k: F.struct(k.alias("pos"), _window_hash("t", i, n))))
        open_ = F.filter(starts, lambda i: F.array_contains(F.slice("n", i, F.lit(n)), True))
        hashes.append(F.flatten(F.transform(open_, lambda i: F.transform(_other_forms(i, n), lambda h: F.struct((i - 1).alias("pos"), h.alias("hash"))))))
        if exact:
            slotted = F.filter(starts, lambda i: F.slice("t", i, F.lit(n)) != F.slice("v", i, F.lit(n)))
            hashes.append(F.transform(slotted, lambda i: F.struct((i - 1).alias("pos"), _window_hash("v", i, n))))
    return step.select(*keep, F.explode(F.concat(*hashes)).alias("x")).select(*keep, "x.pos", "x.hash")


def _window_hash(words: str, start: Column, length: int) -> Column:
    return F.xxhash64(F.slice(words, start, F.lit(length)), F.lit(length)).alias("hash")


def _other_forms(i: Column, n: int) -> Column:
    """Hashes of the window's forms with a placeholder for one or more of the words that may be names; up to two such words go without a loop."""
    next_ = lambda done: F.array_position(F.slice("n", i + done, F.lit(n) - done), True).cast("int")
    first = next_(F.lit(0))
    second = next_(first)
    third = next_(first + second)
    part = lambda words, a, k: F.slice(words, i + a, k)
    mixed = lambda a, b: F.xxhash64(F.concat(part(a, F.lit(0), first), part(b, first, F.lit(n) - first)), F.lit(n))
    whole = _window_hash("p", i, n)
    step = lambda forms, k, words: F.transform(forms, lambda x: F.concat(x, F.array(F.get(words, i - 1 + k))))
    none = F.array().cast("array<array<bigint>>")
    every = F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)),
        F.array(F.array().cast("array<bigint>")),
        lambda forms, k: F.concat(step(forms, k, "t"), F.when(F.get("n", i - 1 + k), step(forms, k, "p")).otherwise(none)),
        lambda forms: F.transform(F.slice(forms, 2, F.size(forms)), lambda x: F.xxhash64(x, F.lit(n))),  # the first is the plain one
    )
    return F.when(second == 0, F.array(whole)).when(third == 0, F.array(whole, mixed("t", "p"), mixed("p", "t"))).otherwise(every)


def _cut(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, length, n_windows, n_usable, at, part, plain, exact): every window of every item, with its words."""
    words = stored(with_words(benchmark, "item_id").where(F.size("w") >= LEAST_WORDS), "benchmark-words")
    # an item shorter than the window is one window of its own length
    length = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    parts = F.transform(starts, lambda i: F.slice(F.col("w"), i, F.least(F.lit(window), F.size("w"))))
    plain = lambda part: F.size(F.filter(part, lambda s: s["t"] == s["v"]))
    usable = F.size(F.filter("parts", lambda part: plain(part) * 2 >= F.size(part)))
    cut = words.select("item_id", length.alias("length"), (F.size("w") - length + 1).alias("n_windows"), parts.alias("parts"))
    cut = cut.select("item_id", "length", "n_windows", usable.alias("n_usable"), F.posexplode("parts").alias("at", "part")).withColumn("plain", plain("part"))
    return cut.withColumn("exact", F.col("plain") * 2 < F.col("length"))


def benchmark_windows(cut: DataFrame) -> DataFrame:
    """(hash, length, item_id, at, n_windows, n_usable, exact, slotted): every window of every item.

    Windows that are plain words for at least half, n_usable of an item's n_windows, are hashed as templates, the others
    (exact) by their words as they are. A template window has a row for each form, as in _windows, that keeps half plain.
    """
    form = lambda x, word, plain: F.struct(F.concat(x["key"], F.array(F.xxhash64(word))).alias("key"), (x["plain"] + plain).alias("plain"))
    empty = F.array(F.struct(F.array().cast("array<bigint>").alias("key"), F.lit(0).alias("plain")))
    forms = F.aggregate(
        "part",
        empty,
        lambda forms, s: F.concat(F.transform(forms, lambda x: form(x, s["t"], (s["t"] == s["v"]).cast("int"))), F.when(s["n"], F.transform(forms, lambda x: form(x, F.lit("<p>"), F.lit(0)))).otherwise(F.slice(forms, 1, 0))),
    )
    usable_forms = F.filter(forms, lambda x: x["plain"] * 2 >= F.col("length"))
    as_is = F.array(F.struct(F.transform("part", lambda s: F.xxhash64(s["v"])).alias("key"), F.col("plain").alias("plain")))
    hashed = cut.withColumn("form", F.explode(F.when(F.col("exact"), as_is).otherwise(usable_forms)))
    hashed = hashed.select(F.xxhash64("form.key", F.col("length")).alias("hash"), "length", "item_id", "at", "n_windows", "n_usable", "exact", (F.col("form.plain") < F.col("length")).alias("slotted"))
    return stored(hashed, "benchmark-windows")


def _finer(text: Column) -> Column:
    """Letters and digits in a row, lower-cased: what words are made of, whatever joins them."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _pairs(words: Column | str, distance: int) -> Column:
    """The hash of each member with the one so many places on; those at the end, with nothing."""
    return F.zip_with(words, F.slice(words, distance + 1, F.greatest(F.lit(0), F.size(words) - distance)), lambda x, y: F.xxhash64(x, y))


def _blocks(words: Column | str, size: int) -> Column:
    """The hashes of 4, 2 or 1 words in a row, from each place."""
    if size == 1:
        return F.transform(words, lambda x: F.xxhash64(x))
    return _pairs(words, 1) if size == 2 else _pairs(_pairs(words, 1), 2)


def _heaviest(words: Column | str, length: int) -> Column:
    """The stretch of so many words with the most letters, as the rarest."""
    part = lambda i: F.slice(words, i, F.lit(length))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (length - 1)))
    return F.array_max(F.transform(places, lambda i: F.struct(F.length(F.array_join(part(i), "")).alias("w"), part(i).alias("words"))))["words"]


def anchors(cut: DataFrame, min_windows: int) -> tuple[DataFrame, dict[int, int]]:
    """(block, window, need): every document that holds an item has need distinct blocks of some window; and the sizes of blocks, with their strides.

    A document that holds an item matches at least min_windows of its windows (or all), so all but one of that many may be
    left out: those with the shortest stretches of firm words. Of each other window's longest stretch 3 + stride words give
    blocks at all places: wherever in a document the stretch lies, one of them starts at a multiple of the stride. Size 0
    stands for a window without firm words.
    """
    next_unit = lambda i: F.coalesce(F.get("part", i + 1)["t"] == "<u>", F.lit(False))
    # a number may be written as one word with its unit
    firm = lambda s, i: F.when(F.col("exact"), (s["t"] != "<u>") & ~next_unit(i)).otherwise((s["t"] == s["v"]) & ~s["n"])
    joined = F.array_join(F.transform("part", lambda s, i: F.when(firm(s, i), s["v"]).otherwise(F.lit("\x01"))), " ")
    runs = F.transform(F.split(joined, "\x01"), lambda r: F.filter(_finer(r), lambda x: x != ""))
    own = cut.select("item_id", "at", "n_windows", "n_usable", runs.alias("runs")).withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(F.size(r).alias("n"), r.alias("words")))))
    usable = F.when(F.col("n_usable") > 0, F.least(F.lit(min_windows), "n_usable")).otherwise(min_windows)
    needed = F.least(usable, F.least(F.lit(min_windows), "n_windows"))
    n = F.col("best.n")
    kept = own.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("best.n", "at"))).where(F.col("r") >= needed)
    size, stride = F.when(n >= 4, 4).when(n >= 2, 2).otherwise(n), F.when(n >= 7, 4).when(n >= 5, 2).otherwise(1)
    kept = stored(kept.select("item_id", "at", "runs", "best.words", size.alias("size"), stride.alias("stride")), "benchmark-stretches")
    sizes = {r["size"]: r["stride"] for r in kept.groupBy("size").agg(F.min("stride").alias("stride")).collect()}  # four at most
    found = [kept.select(F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("window"), F.lit(1).alias("need")).limit(0)]
    for k, step in sizes.items():
        if k == 4:
            blocks = F.slice(_blocks("stretch", 4), 1, step)
            found.append(kept.where("size = 4").select(_heaviest("words", 3 + step).alias("stretch")).select(F.explode(blocks).alias("block")).select("block", F.col("block").alias("window"), F.lit(1).alias("need")))
        elif k:
            long = F.filter("runs", lambda r: F.size(r) >= k)  # noqa: B023
            of = F.flatten(F.transform(long, lambda r: F.slice(_blocks(r, 2), 1, F.size(r) - 1))) if k == 2 else F.transform(F.flatten(long), lambda x: F.xxhash64(x))
            both = kept.where(F.col("size") == k).select(F.xxhash64("item_id", "at").alias("window"), F.array_distinct(of).alias("blocks"))
            found.append(both.select(F.explode("blocks").alias("block"), "window", F.size("blocks").alias("need")))
    return stored(reduce(DataFrame.unionByName, found).distinct(), "benchmark-anchors"), sizes


def _candidates(keyed: DataFrame, found: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """The rows (doc_id, h, text) that can hold an item, by the anchors; all where a window has none."""
    if 0 in sizes:
        return keyed
    if not sizes:
        return keyed.where(F.lit(False))
    words = keyed.select("doc_id", "h", _finer(F.coalesce("text", F.lit(""))).alias("words"))
    words = words.select("doc_id", "h", "words", _blocks("words", 2).alias("twos"))  # a column, so that fours come from it too
    stride = sizes.get(4, 1)
    fours = _pairs("twos", 2) if stride == 1 else F.filter(_pairs("twos", 2), lambda x, i: i % stride == 0)
    every = {1: _blocks("words", 1), 2: F.col("twos"), 4: fours}
    blocks = words.select("doc_id", "h", F.explode(F.concat(*[every[k] for k in sorted(sizes)])).alias("block"))
    met = blocks.join(bounded_broadcast(found), "block").groupBy(F.col("doc_id").alias("met_id"), F.col("h").alias("met_h"), "window", "need").agg(F.count_distinct("block").alias("n"))
    hit = stored(met.where("n >= need").select("met_id", "met_h").distinct(), "benchmark-candidates")
    same = keyed["doc_id"].eqNullSafe(F.col("met_id")) & (keyed["h"] == F.col("met_h"))
    return stored(keyed.join(bounded_broadcast(hit), same, "left_semi"), "candidate-texts")


def matches(docs: DataFrame, benchmark: DataFrame, rule: Rule | None = None) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots, coverage): a row for each document and item that it holds.

    Null and empty texts, and items of fewer than four words, match nothing; so do empty tables. Rows that repeat an id
    with other texts are searched each and reported together; the same text again adds nothing. A null id is an id.
    """
    rule = rule or Rule()
    cut = _cut(benchmark, rule.window)
    bench = benchmark_windows(cut)
    lengths = sorted(r["length"] for r in bench.select("length").distinct().collect())  # at most as many as the window is long
    if not lengths:
        lengths = [rule.window]
    keyed = _candidates(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), *anchors(cut, rule.min_windows))
    exact = not bench.where("exact").isEmpty()
    found = _windows(with_words(keyed, "doc_id", "h"), lengths, exact, "doc_id", "h")
    hit = found.join(bounded_broadcast(bench), "hash")
    # a window met by plain words alone needs no look at its slots, whatever other forms of it are met
    each = hit.select("doc_id", "h", "pos", "item_id", "at", "length", "n_windows", "n_usable", "exact", "slotted", (F.col("pos") - F.col("at")).alias("shift"))
    hits = stored(each.groupBy(*[c for c in each.columns if c != "slotted"]).agg(F.min("slotted").alias("slotted")), "benchmark-hits")

    # slots along each alignment: only documents with a hit on a window with slots are read again
    held = stored(hits.where("slotted").select(F.col("doc_id").alias("held_id"), F.col("h").alias("held_h")).distinct(), "slotted-documents")
    held = bounded_broadcast(held)
    # stored, since filters on the words would else be worked out for all documents before the join
    again = stored(keyed.join(held, keyed["doc_id"].eqNullSafe(held["held_id"]) & (keyed["h"] == held["held_h"]), "left_semi"), "slotted-texts")
    slot = F.when(F.col("s.n"), F.lit("<p>")).otherwise(F.col("s.t")).alias("kind")
    slots_of = lambda df, side, *keys: with_words(df, *keys).select(*keys, F.posexplode("w").alias("place", "s")).where("s.t <> s.v OR s.n").select(*keys, "place", slot, F.col("s.v").alias(f"{side}_value"), F.col("s.n").alias(f"{side}_open")).distinct()
    doc_slots = slots_of(again, "doc", "doc_id", "h").withColumn("id_key", F.struct("doc_id")).drop("doc_id")
    item_slots = bounded_broadcast(stored(slots_of(benchmark, "item", "item_id"), "item-slots"))
    covered = hits.select("doc_id", "h", "item_id", "shift", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("place"))
    # most places are plain words, which the join leaves out before anything is shuffled
    met = covered.join(item_slots, ["item_id", "place"]).distinct().withColumn("place", F.col("place") + F.col("shift")).withColumn("id_key", F.struct("doc_id"))
    along = ["id_key", "h", "item_id", "shift"]
    both = stored(met.join(doc_slots, ["id_key", "h", "place", "kind"]), "slots-met")
    differ = lambda c, *by: F.min(c).over(Window.partitionBy(*along, "kind", *by)) < F.max(c).over(Window.partitionBy(*along, "kind", *by))
    clash = (F.col("item_value") != F.col("doc_value")) & (differ("doc_value", "item_value") | ((F.col("kind") == "<p>") & differ("item_value", "doc_value")))
    judged = both.withColumn("clash", clash)
    clashing = judged.where("clash").groupBy(*along).agg(F.collect_set(F.col("place") - F.col("shift")).alias("clashes"))  # at most an item's length
    is_slot = ~(F.col("item_open") | F.col("doc_open")) | (F.col("item_value") != F.col("doc_value"))
    n_slots = F.count_distinct(F.when(is_slot, F.struct("kind", "item_value", "doc_value"))).alias("n_slots")
    slots = judged.where("not clash").groupBy(*along).agg(n_slots).groupBy("id_key", "item_id").agg(F.max("n_slots").alias("n_slots"))
    over = F.exists("clashes", lambda x: (x >= F.col("at")) & (x < F.col("at") + F.col("length")))
    good = hits.withColumn("id_key", F.struct("doc_id")).join(clashing, along, "left").where(~F.coalesce(over, F.lit(False)))
    usable_at = F.count_distinct(F.when(~F.col("exact"), F.col("at"))).alias("n_template")
    pairs = good.groupBy("id_key", "item_id").agg(F.count_distinct("at").alias("n_matched"), usable_at, F.max("n_windows").cast("long").alias("n_windows"), F.max("n_usable").alias("n_usable"))
    by_template = (F.col("n_usable") > 0) & (F.col("n_template") >= F.least(F.lit(rule.min_windows), F.col("n_usable")))
    kept = pairs.where(by_template | (F.col("n_matched") >= F.least(F.lit(rule.min_windows), F.col("n_windows"))))
    out = kept.join(slots, ["id_key", "item_id"], "left")
    return out.select(F.col("id_key.doc_id").alias("doc_id"), "item_id", "n_matched", "n_windows", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.round(F.col("n_matched") / F.col("n_windows"), 6).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule | None = None) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns as they are."""
    return without_ids(docs, stored(matches(docs, benchmark, rule).select("doc_id").distinct(), "contaminated"))
