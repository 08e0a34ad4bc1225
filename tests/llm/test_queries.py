"""Registered queries of the package against their SQL, and the pipeline against
a plain version of its stages."""

import re

import duckdb
import pytest

from tests.conftest import SF_SMALL
from tests.llm.test_operators import shingles
from tests.test_oracle import norm
from quire.llm.catalog import ORACLE, QUERIES
from quire.sources.tables import TABLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got, want = norm(QUERIES[name](spark, SF_SMALL).toPandas()), norm(con.execute(ORACLE[name]).df())
    assert got == want


def test_ten_queries_and_pipeline():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from quire.llm import quality
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    steps = [docs]
    for _, stage in cp.STAGES:
        steps.append(stage(spark, steps[-1], SF_SMALL).cache())
    for s in steps[1:-1]:
        assert s.schema == docs.schema
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    kept = {r.doc_id for r in quality.measure(docs).where("kept").collect()}
    assert set(rows[1]) == kept
    left = sorted(rows[2])
    sets = {i: shingles(rows[1][i].text) for i in rows[1]}
    near = lambda a, b: len(a & b) * 10 >= 8 * len(a | b)
    assert not any(near(sets[a], sets[b]) for k, a in enumerate(left) for b in left[:k])
    assert all(any(near(sets[i], sets[j]) for j in sets if j != i) for i in set(rows[1]) - set(left))
    leaks = {i for i in left if any(q and len(q & sets[i]) * 10 >= 8 * len(q) for q in items)}
    assert set(rows[3]) == set(left) - leaks
    assert set(rows[4]) == set(rows[3]) == set(rows[5])
    token = re.compile(r"[0-9a-f]{24,}")
    assert not any(token.search(r.text) for r in rows[4].values())
    assert all(r.n_tokens == len(r.ids) for r in rows[5].values())
    assert cp.run(spark, SF_SMALL).count() == len(rows[5])


def test_pipeline_decodes_its_ids(spark):
    import hashlib
    import corpus_pipeline as cp
    texts = [(1, "One, two  three\n"), (2, "àéî 漢字 🙂 x" * 40), (3, ""), (4, None), (4, None), (5, "a" * 3000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = cp.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == sorted(
        (i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
