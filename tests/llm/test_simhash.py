import random

import numpy as np
import xxhash

from phraseloom.llm import simhash_dedup as m


def plain_fingerprint(text, n=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{id: smallest id reachable} of (id, fingerprint)."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(fps):
        for j, b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_fingerprint_of_bytes_and_spark():
    for text in ("", " \n", "A b", "a B c D e", "É é Ā\x0bz", "x " * 50):
        assert m.fingerprint(text) == plain_fingerprint(text)


def test_links_equal_brute_force(spark):
    draw = random.Random(1)
    fps = {draw.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:25]:
        for flips in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in draw.sample(range(64), flips)))
    dense = draw.getrandbits(64)
    fps |= {dense ^ k for k in range(64)}  # one crowded neighbourhood
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    table = spark.createDataFrame(signed, "fp long")
    want = {(min(a, b), max(a, b)) for k, (a,) in enumerate(signed) for (b,) in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for limit in (512, 4):  # the second splits crowded keys
        assert {tuple(r) for r in m.links(table, limit).collect()} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in m.components(edges).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_near_duplicates(spark, edges):
    found = m.near_duplicates(edges).collect()
    assert len(found) == edges.count()
    rows = [(r["doc_id"], r["text"]) for r in edges.collect() if r["doc_id"] is not None]
    want = plain_components([(i, plain_fingerprint(t)) for i, t in dict(rows).items()])
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    assert all(r["fingerprint"] == f"{plain_fingerprint(dict(rows)[r['doc_id']]):016x}" for r in found if r["doc_id"] is not None)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [5]


def test_drop_keeps_one_of_each(edges, nothing):
    kept = m.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7]
    assert m.drop_near_duplicates(nothing).count() == 0 and m.near_duplicates(nothing).count() == 0


def test_similar_documents_equal_brute_force(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    texts = [[word() for _ in range(draw.randint(40, 90))] for _ in range(40)]
    for base in texts[:12]:
        for _ in range(3):
            copy = list(base)
            for _ in range(draw.randint(1, 3)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(copy)
    shared = [word() for _ in range(60)]  # many that share a passage without being alike
    texts += [shared + [word() for _ in range(40)] for _ in range(12)]
    texts += [["a", "b"], ["a", "b"], []]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [{" ".join(t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set() for t in texts]
    fps = [m.fingerprint(" ".join(t), 5) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            alike = len(a & sets[j]) >= 0.8 * len(a | sets[j]) if a or sets[j] else True
            if alike or (fps[i] ^ fps[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {k: find(k) for k in range(len(texts))}
    assert len(set(want.values())) < len(texts) - 8
    assert {r["doc_id"]: r["component_id"] for r in m.similar_documents(docs).collect()} == want
    assert {r["doc_id"] for r in m.drop_near_duplicates(docs).collect()} == set(want.values())


def plain_similar(texts, fps, alike):
    """{number: smallest number reachable} over pairs that alike() or the fingerprints link."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]) or (fps[i] ^ fps[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in range(len(texts))}


def test_a_crowd_of_near_copies_by_cosine(spark):
    """Copies of one text, more than a bucket compares outright, of which some are like the text and some only like those."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = [base]
    for _ in range(50):
        copy = list(base)
        for _ in range(draw.randint(1, 9)):
            copy[draw.randrange(len(copy))] = word()
        texts.append(copy)
    texts += [[word() for _ in range(100)] for _ in range(20)]
    sets = [{" ".join(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    fps = [m.fingerprint(" ".join(t), 5) for t in texts]
    want = plain_similar(sets, fps, lambda a, b: len(a & b) >= 0.8 * (len(a) * len(b)) ** 0.5)
    docs = spark.createDataFrame([(k, " ".join(t), 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, other_id int, lost_id int")
    found = {r["doc_id"]: r["component_id"] for r in m.similar_documents(docs, m.Similar(measure="cosine")).collect()}
    linked = lambda by: {(a, b) for a in by for b in by if a < b and by[a] == by[b]}
    assert linked(found) <= linked(want) and len(linked(found)) >= 0.95 * len(linked(want))
    assert m.drop_near_duplicates(docs).columns == docs.columns
