"""The registered queries over the small tables, their SQL, and the pipeline's stages."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from strictpast.llm.oracle import ORACLE
from strictpast.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql()) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    found = con.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    key = df.columns[0]
    if name not in ("op1_suffix_dedup", "op5_decontaminate"):
        table = "embeddings" if key == "vec_id" else "documents"
        copies = 4 if name == "op11_whitening" else 1
        assert len(rows) == copies * spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_pipeline_stages(spark):
    """Each stage's decisions by plain Python on the stage's own input."""
    from test_text_dedup import brute_lines, shingles, union

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, state = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = [shingles(r.text, 5, short=False) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for name, function in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(function(spark, docs, SF_DIR).collect(), docs.schema)
        assert docs.columns == columns
        now, ids = {r.doc_id: r.text for r in docs.collect()}, sorted(state)
        if name == "language_id":
            want = {i: t for i, t in state.items() if t and any(map(str.isalpha, t))}
        elif name == "line_dedup":
            want = {i: t for i, (t, n, gone) in zip(ids, brute_lines([state[i] for i in ids], 2, 50)) if gone == 0 or gone < n}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "minhash_dedup":
            sets = [shingles(state[i], 5) for i in ids]
            links = [(a, b) for b in range(len(ids)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            want = {ids[i]: state[ids[i]] for i, c in enumerate(union(len(ids), links)) if i == c}
        else:
            mine = {i: shingles(t, 5, short=False) for i, t in state.items()}
            want = {i: state[i] for i in ids if not any(q and 100 * len(q & mine[i]) >= 80 * len(q) for q in bench)}
        assert now == want, name
        state = now
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id: r.decoded for r in last} == {i: t.replace("▁", " ") for i, t in state.items()}


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
