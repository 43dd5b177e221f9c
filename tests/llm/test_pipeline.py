from phraseloom.llm import bpe, quality_rules, simhash_dedup
from phraseloom.llm.common import table


def test_stages_against_plain_versions(spark, tmp_path, prose):
    import corpus_pipeline as p

    good, bad = prose
    item = "the quick answer to this question about rivers is written in the second book of maps"
    licence = "released under some licence"
    texts = [t + ("\n" + licence if k < 20 else "") for k, t in enumerate(good)]
    texts[30] += "\n" + item
    texts += [texts[40], texts[40], None, "", "short"] + bad
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < len(good)), 0) for k in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    model = quality_rules.fit(docs, table(spark, str(tmp_path), "labels"))
    kept = {k: t for k, t in enumerate(texts) if not quality_rules.base_failed(quality_rules.statistics(t or "")[0]) and not model.rejects(model.scores(__import__("numpy").array([quality_rules.statistics(t)[1]])))[0]}
    kept = {k: "\n".join(x for x in t.split("\n") if x != licence) for k, t in kept.items()}
    first = {}
    for k, t in sorted(kept.items()):
        own = set(simhash_dedup.shingle_hashes(t, 5).tolist())
        if not any(len(own & x) >= 0.8 * len(own | x) for x in first.values()):
            first[k] = own
    want = {k: kept[k] for k in first if item not in kept[k]}
    assert 30 in kept and 30 not in want and not {len(good), len(good) + 1} & set(want)
    own = bpe.load(__import__("public_tokenizers").path("word_bpe_49k.json"))
    found = {r["doc_id"]: r["n_tokens"] for r in p.run(spark, str(tmp_path)).collect()}
    assert found == {k: len(own.encode(t)) for k, t in want.items()}
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
