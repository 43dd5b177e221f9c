import hashlib
import random

import numpy as np

from phraseloom.llm import line_dedup as m

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(rows, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = {k for k, v in holders.items() if k and len(v) >= least}
    return [(i, (t or "").split("\n"), [x for x in (t or "").split("\n") if key(x) not in gone]) for i, t in rows]


def corpus():
    draw = random.Random(2)
    often = ["  Common LINE", "common line", "released under a licence\t", "Ünïcode Line"]
    rows = [(k, "\n".join(draw.sample([*often, f"own {k}", "", f"pair {k // 2}"], 5))) for k in range(60)]
    return [*rows, (60, None), (61, ""), (62, "common line\nx\r\ncommon line")]


def test_cuckoo_filter_is_exact_about_members_and_reversible():
    own, keys = m.CuckooFilter(3000), np.random.default_rng(1).integers(-(2**63), 2**63, 4000)
    for h in keys[:3000].tolist():
        own.add(h)
    assert own.has(keys[:3000]).all() and own.has(keys[3000:]).mean() < 0.01
    again = m.CuckooFilter.unpack(own.pack())
    assert again.has(keys[:3000]).all()
    assert all(again.remove(h) for h in keys[:1500].tolist())
    assert again.has(keys[1500:3000]).all() and again.has(keys[:1500]).mean() < 0.01
    crowded = m.CuckooFilter(16)
    for h in keys[:200].tolist():  # more than fit: kept apart, never lost
        crowded.add(h)
    assert crowded.has(keys[:200]).all() and m.CuckooFilter.unpack(crowded.pack()).has(keys[:200]).all()


def test_both_ways_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    want = {i: (len(ls), len(ls) - len(ks), hashlib.sha256("\n".join(ks).encode()).hexdigest()) for i, ls, ks in plain(rows, 10)}
    for size in (64 << 20, 0):
        assert {r[0]: tuple(r)[1:] for r in m.dedup_lines(docs, 10, True, size).collect()} == want
        texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in m.dedup_lines(docs, 10, False, size).collect()}
        for i, ls, ks in plain(rows, 10):
            assert (texts[i][0] or "") == "\n".join(ks) and texts[i][1] == len("\n".join(ks))


def test_index_is_reversible(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = docs.where("doc_id % 3 = 0")
    index = m.LineIndex(spark, str(tmp_path / "index"), min_docs=10, shard_keys=1)
    index.insert(docs).delete(some)
    rest = m.LineIndex(spark, str(tmp_path / "rest"), min_docs=10).insert(docs.where("doc_id % 3 <> 0"))
    assert {tuple(r) for r in index.counts.collect()} == {tuple(r) for r in rest.counts.collect()}
    assert index.shards == index.n_frequent and {tuple(r) for r in index.apply(docs, digest=True).collect()} == {tuple(r) for r in rest.apply(docs, digest=True).collect()}
    index.insert(some)
    assert {tuple(r) for r in index.apply(docs, digest=True).collect()} == {tuple(r) for r in m.dedup_lines(docs, 10, True).collect()}


def test_untouched_shards_keep_their_files(spark, tmp_path):
    lines = [f"line {k}" for k in range(12)]
    docs = spark.createDataFrame([(k, "\n".join(lines)) for k in range(10)], "doc_id long, text string")
    index = m.LineIndex(spark, str(tmp_path / "index"), min_docs=10, shard_keys=2)
    index.insert(docs)
    assert index.shards == 6
    before = {r["shard"]: r["filter"] for r in index.filters.collect()}
    written = dict(index.written)
    one = spark.createDataFrame([(0, lines[0])], "doc_id long, text string")
    index.delete(one)  # that line alone falls under the threshold
    hi, lo = m.line_hash(lines[0].encode())
    after = {r["shard"]: r["filter"] for r in index.filters.collect()}
    assert {s for s in before if before[s] != after[s]} == {lo % 6} == {s for s in written if written[s] != index.written[s]}
    assert not m.CuckooFilter.unpack(after[lo % 6]).has(np.array([hi]))[0]
    assert {r["n_dropped"] for r in index.apply(docs, digest=True).collect()} == {11}
    index.insert(one)
    assert {r["n_dropped"] for r in index.apply(docs, digest=True).collect()} == {12}
    many = spark.createDataFrame([(k, "\n".join(f"new {i}" for i in range(400))) for k in range(10, 20)], "doc_id long, text string")
    index.insert(many)  # more than the filters have room for
    assert {r["n_dropped"] for r in index.apply(many, digest=True).collect()} == {400}
    assert not any(m.CuckooFilter.unpack(r["filter"]).full() for r in index.filters.collect())


def test_wrongly_passed_lines_stay(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = m.LineIndex(spark, min_docs=10).insert(docs)
    probe = m.Probe(spark, {0: m.CuckooFilter.unpack(index.filters.first()["filter"]).pack()}, 1)
    rare = m.line_hash(b"own 3")
    own = m.CuckooFilter.unpack(probe.held.value[0])
    own.add(rare[0])
    wrong = m.Probe(spark, {0: own.pack()}, 1)
    assert m._passed(index.counts.where("n_docs < 10").select("hi", "lo"), wrong).collect() == [rare]
    wrong.wrong = frozenset([rare])
    assert wrong.dropped([rare, m.line_hash(b"common line")]) == {m.line_hash(b"common line")}


def test_edges(edges, nothing):
    assert m.dedup_lines(edges, 1).columns == edges.columns
    assert m.dedup_lines(edges, 10, True).count() == edges.count()
    gone = {r["doc_id"]: r["text"] for r in m.dedup_lines(edges, 3).collect()}
    assert gone[5] == gone[6] == "" and gone[1] is None and gone[3] == " \n\t "  # ids 5, 6 and null hold the line
    assert m.dedup_lines(nothing, 2).count() == 0
