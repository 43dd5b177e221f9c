import numpy as np
import pytest
import zstandard

from phraseloom.llm import language_ecoc, quality_compression, quality_rules, toxicity


def labelled(spark, good, bad):
    texts = [(k, t) for k, t in enumerate(good + bad)]
    labels = [(k, int(k < len(good)), int(k >= len(good))) for k in range(len(texts))]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_base(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    marked, windows = set(), [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            marked |= {k, k + 1, k + 2}
    seen, duplicates = set(), 0
    for x in (text or "").split("\n"):
        if x.strip(" \t\n\x0b\x0c\r"):
            duplicates += x in seen
            seen.add(x)
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), duplicates, len(marked)]


@pytest.mark.parametrize("text", ["", None, "a", "a b c a b c", "a a a a", "a b a b a b c", "x\nx\n\n \n \nx", "# $ <b> | a b"])
def test_base_statistics(text):
    assert quality_rules.statistics(text or "")[0] == plain_base(text)


def test_quality_rules(spark, edges, nothing, prose):
    good, bad = prose
    docs, labels = labelled(spark, good, bad)
    model = quality_rules.fit(docs, labels)
    rows = quality_rules.score_table(docs, model).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len([i for i in range(len(good)) if i in kept]) >= 0.97 * len(good)
    assert len([i for i in range(len(good), len(good) + len(bad)) if i in kept]) <= 0.05 * len(bad)
    assert {r["doc_id"] for r in quality_rules.keep_good(docs, model).collect()} == kept
    assert quality_rules.score_table(edges, model).count() == edges.count()
    assert quality_rules.keep_good(edges, model).count() == 0  # all short or repetitive
    blank = quality_rules.fit(nothing, labels.limit(0))
    assert blank.forest is None and quality_rules.keep_good(docs, blank).count() == sum(not quality_rules.base_failed(plain_base(t)) for t in good + bad)


def test_path_lengths_by_hand():
    rows = np.random.default_rng(0).normal(size=(300, 2))
    forest = quality_rules.IsolationForest(rows, trees=20)

    def walk(x, root):
        at = root
        while forest.below[at] != at:
            at = forest.below[at] if x[forest.statistic[at]] <= forest.split[at] else forest.above[at]
        return forest.length[at]

    some = np.vstack([rows[:5], [[9, 9]]])
    want = [2 ** -(np.mean([walk(x, r) for r in forest.roots]) / forest.mean) for x in some]
    assert np.allclose(forest.scores(some), want) and forest.scores(some)[-1] > forest.scores(rows).max()


def test_compression(spark, edges, nothing, prose):
    good, bad = prose
    docs, labels = labelled(spark, good, bad)
    model = quality_compression.fit(docs, labels)
    scores = model.scores(good + bad)
    assert (scores[: len(good)] >= 0.5).mean() > 0.95 and (scores[len(good) :] < 0.5).mean() > 0.9
    text = good[0]
    sizes = [sum(len(zstandard.ZstdCompressor(level=model.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(p)) for p in quality_compression.pieces(text)) for d in (model.good, model.bad)]
    assert model.measure(text) == pytest.approx((sizes[1] - sizes[0]) / len(text.encode()))
    rows = quality_compression.score_table(edges, model, 0.3).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_compression.score_table(nothing, model, 0.3).count() == 0
    assert quality_compression.fit(nothing, labels.limit(0)).scores(["a", ""]).tolist() == [0.5, 0.5]


def test_held_out_folds(spark):
    import zlib

    docs = spark.createDataFrame([(k, "t") for k in range(50)] + [(None, "t")], "doc_id long, text string")
    model = quality_compression.CompressionModel(b"", b"")
    held = {r["doc_id"]: r["held_out"] for r in quality_compression.score_table(docs, model, 0.3).collect()}
    assert held == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(50)} | {None: False}


def test_toxicity_and_counterfactuals(spark, edges, nothing, prose):
    good, _ = prose
    harsh = [t.replace(".", " you vile fool.", 3) for t in good[:60]]
    # in the toxic examples one group is always named; in the clean ones never
    named = [t + " Muslim." for t in harsh]
    plain = toxicity.train(named + good[60:], [1] * 60 + [0] * 100, counterfactual=0.0)
    fair = toxicity.train(named + good[60:], [1] * 60 + [0] * 100, counterfactual=20.0)
    gap = lambda m: abs(float(np.diff(np.log(m.scores(["a muslim friend came", "a hindu friend came"]) / (1 - m.scores(["a muslim friend came", "a hindu friend came"]))))[0]))
    assert gap(plain) > 0.3 and gap(fair) < 0.25 * gap(plain)
    fresh = good[60:80]
    assert (fair.scores([t + " you vile fool" for t in fresh]) >= 0.5).mean() > 0.9 and (fair.scores(fresh) < 0.5).mean() > 0.9
    rows = toxicity.score_table(edges, fair).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
    docs, labels = labelled(spark, harsh, good)
    assert toxicity.fit(nothing, labels).weights == {} and len(toxicity.fit(docs, labels).weights) > 0


def test_swaps():
    assert toxicity.swaps("A gay man. Nothing here")[0] == (["gay", "man"], ["straight", "girl"])


def test_languages(spark, edges, nothing):
    words = {"aa": "la re mi fo", "bb": "ung ich der sch", "cc": "ción que ñor", "dd": "été oux ai", "ee": "tion the ing wh", "ff": "ijk oo een het", "gg": "ska och att"}
    draw = np.random.default_rng(1)
    texts = [(" ".join(draw.choice(w.split(), 30)), lang) for lang, w in words.items() for _ in range(40)]
    for names in (["aa", "bb"], list(words)):  # exhaustive and random codes
        own = [(t, lang) for t, lang in texts if lang in names]
        model = language_ecoc.train([t for t, _ in own], [lang for _, lang in own])
        assert [p[0] for p in model.predict([t for t, _ in own])] == [lang for _, lang in own]
        margins = model.margins(np.stack([language_ecoc.features(own[0][0])]))
        losses = [(np.logaddexp(0, -margins[0] * word) * model.trust).sum() for word in model.code]
        assert model.languages[int(np.argmin(losses))] == model.predict([own[0][0]])[0][0]
    assert model.predict(["", "123 !?", "  "]) == [("und", 0.0, True)] * 3
    rows = language_ecoc.predict_table(edges, model).collect()
    assert len(rows) == edges.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language_ecoc.fit(nothing).languages == [] and language_ecoc.fit(edges).languages == ["en"]


def test_long_text_in_parts(monkeypatch):
    text = "abc déf 中 " * 500
    whole = language_ecoc.features(text)
    monkeypatch.setattr(language_ecoc, "PART", 700)
    assert np.abs(language_ecoc.features(text) - whole).max() < 0.02


def test_quality_is_fitted_on_every_labelled_document(spark, monkeypatch):
    """At most 3,000 documents of a label were fitted on before."""
    text = "some words of a plain text " * 2 + " ".join(f"n{k} m{k} o{k}" for k in range(40))
    docs, labels = labelled(spark, [f"{text} {k}" for k in range(3100)], [f"{text} # # {k}" for k in range(50)])
    seen = []
    monkeypatch.setattr(quality_rules, "QualityModel", lambda vectors, own, loss: seen.append((vectors.shape, np.bincount(own).tolist())))
    quality_rules.fit(docs, labels)
    monkeypatch.setattr(quality_rules, "BROADCAST_BYTES", 0)
    quality_rules.fit(docs, labels)
    assert seen == [((3150, 10), [50, 3100])] * 2
