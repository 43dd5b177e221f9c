"""The closed miner's query at an absolute support, on a small corpus, against brute force."""

import random

from phraseloom.functions.text import tokenize
from phraseloom.plans import queries as q
from tests.texts import LONG, NOTIFY, brute_closed


def test_closed_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(4)
    texts = [f"{draw.random()} {LONG}. {NOTIFY if k % 4 else ''} {draw.random()}" for k in range(14)] + ["go " * 16]
    texts += [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 30))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lists = [r["t"] for r in docs.select(tokenize("text").alias("t")).collect()]
    want = {(k, *v) for k, v in brute_closed(lists, 10, 3).items()}
    rows = q.queries()["phrases_closed"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r["phrase"], r["freq"], r["df"]) for r in rows} == want
    assert " ".join(["go"] * 7) in {r["phrase"] for r in rows}
