"""The pipeline and the queries with SQL on the smallest table."""

import duckdb
import pytest

import corpus_pipeline
from cellframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    rows = sorted(repr([r[n] for n in order]) for r in df.collect())
    assert rows == sorted(repr([r[names.index(n)] for n in order]) for r in cur.fetchall())


def test_pipeline_keeps_clean_documents(spark, sf):
    """Against the stages' rules by hand: exact copies and benchmark passages go, the rest stays once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for d, t in sorted(texts.items()):
        first.setdefault(t, d)
    assert set(out) <= set(first.values())
    hit = {r.doc_id for r in QUERIES["op4_positional_index_decontamination"](spark, sf).collect() if r.contaminated}
    assert not hit & set(out)
    classes = {r.doc_id: r.class_id for r in QUERIES["op8_dart_minhash_near_dup"](spark, sf).collect()}
    lettered = {d for d, t in texts.items() if t and any(map(str.isalpha, t))}
    assert set(out) == {d for d in lettered if classes[d] == d} - hit
    assert all(r.n_tokens == len(r.ids) for r in out.values())


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0
