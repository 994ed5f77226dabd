"""Registered queries on the smallest tables, those with SQL against it, and the pipeline against its stages."""

import duckdb
import pytest

import corpus_pipeline
from checks.compare import KINDS, _rows, connect
from gleanframe.llm import pieces
from gleanframe.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    relation = connect(FOLDER).sql(ORACLES[name])
    assert {f.name: KINDS.get(f.dataType.simpleString()) for f in df.schema} == dict(zip(relation.columns, map(str, relation.types)))
    assert _rows(df.toPandas()) == _rows(relation.df())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, ids = docs, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name.replace(' ', '-')}-{id(after)}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
        kept = {r.doc_id for r in before.collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids), name
        ids = kept
    last = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER).collect()
    import sentencepiece
    reference = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert all(r.ids == reference.encode(r.text) for r in last[:50]) and len(last) == len(ids)


def test_high_quality_documents_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, FOLDER).select("doc_id").collect()}
    good = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/labels.parquet' JOIN '{FOLDER}/documents.parquet' USING (doc_id) "
                                     "WHERE quality = 1 AND len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) >= 50").fetchall()}
    assert len(good - kept) <= 0.01 * len(good)
