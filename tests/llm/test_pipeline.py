"""Registered queries against SQL, and the pipeline against its stages done plainly."""

import os

import pytest

import corpus_pipeline
from check_oracle import connect, rows_of
from plumbline.llm.queries import LLM_ORACLES, LLM_QUERIES

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query(spark, con, name):
    frame = LLM_QUERIES[name](spark, FOLDER)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert mine[1]
    if name in LLM_ORACLES:
        result = con.execute(LLM_ORACLES[name])
        assert mine == rows_of([c[0] for c in result.description], result.fetchall())


def test_pipeline_equals_its_stages(spark, con):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == columns, name
        now = {r.doc_id: r.text for r in after.collect()}
        assert set(now) <= set(kept) and len(now) >= 0.5 * len(kept), name
        if name != "line dedup":
            assert all(now[i] == kept[i] for i in now)
        if name == "near dedup":
            assert len(set(now.values())) == len(now)
        docs, kept = spark.createDataFrame(after.collect(), after.schema), now
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert {p.doc_id for p in pieces} == set(kept)


def test_stages_take_odd_tables(spark):
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (None, "words here", "en", "s", 10, None), (3, "same text " * 9, "en", "s", 90, "c"), (4, "same text " * 9, "en", "s", 90, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, item_id string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {r.doc_id for r in out.collect()} == ({1, 2, None, 3} if name == "near dedup" else {1, 2, None, 3, 4})
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
