"""Each registered query of the subpackage on a small table, held against plain versions and SQL."""

import hashlib
import zlib

import duckdb
import pytest

from phraseloom.llm import queries as q
from phraseloom.llm import simhash_dedup

TABLES = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op2_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept"],
    "op3_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_language_ecoc": ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
    "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_quality_compression": ["doc_id", "held_out", "score", "predicted"],
    "op10_kd_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, texts, name):
    df = q.queries()[name](spark, TABLES)
    assert df.columns == COLUMNS[name]
    rows = {r["doc_id"]: r for r in df.collect()}
    assert rows.keys() == texts.keys() and df.count() == len(texts)
    if name == "op1_simhash_dedup":
        assert all(int(r["fingerprint"], 16) == simhash_dedup.fingerprint(texts[i] or "") for i, r in rows.items())
    if name == "op3_line_dedup":
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TABLES}/documents.parquet'")
        assert {tuple(r) for r in rows.values()} == set(con.execute(q.oracle_sql()[name]).fetchall())
    if name == "op8_bpe":
        public = pytest.importorskip("public_tokenizers")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(public.path("word_bpe_49k.json"))
        own.no_truncation()
        own.no_padding()
        for i, text in texts.items():
            ids = own.encode(text or "", add_special_tokens=False).ids
            raw = b"".join(k.to_bytes(4, "little") for k in ids)
            decoded = own.decode(ids, skip_special_tokens=False)
            assert tuple(rows[i])[1:] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    if name == "op10_kd_sharding":
        assert all((r["size"], r["text_crc32"]) == (len((texts[i] or "").encode()) + 1, zlib.crc32((texts[i] or "").encode())) for i, r in rows.items())
