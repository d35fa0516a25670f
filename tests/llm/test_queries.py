"""The registered queries of this package against their SQL, and the pipeline's stages on a small table."""

import os

import pytest

from lectern.llm.queries import QUERIES, SQL

from ..oracle import DIR, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = cp.run(spark, DIR)
    assert [n for n, _ in cp.STAGES] and set(docs.columns) <= set(out.columns) and {"rate", "posterior"} <= set(out.columns)
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and len({r.doc_id for r in rows}) == len(rows) and all(r.rate >= 0 and r.n_chars == len(r.text) for r in rows)
    texts = [line for r in rows for line in r.text.split("\n") if len(line) >= 8]
    assert len(texts) == len(set(texts))
