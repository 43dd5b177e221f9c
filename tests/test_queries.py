"""Each query with SQL, on a small corpus, against DuckDB."""

import random

import duckdb
import pytest

from phraseloom.plans import queries as q
from tests.texts import COVERED, NOTICES

ORACLES = q.oracle_sql()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw, path = random.Random(9), str(tmp_path_factory.mktemp("tables"))
    texts = NOTICES * 4 + COVERED * 2 + [" ".join(draw.choice("abcde") for _ in range(draw.randint(0, 40))) for _ in range(60)] + [None, "", "É É É É e-É"]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    found = q.queries()[name](spark, tables)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    want = base.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
