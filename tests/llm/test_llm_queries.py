"""Queries against their SQL, and the pipeline stage by stage on a small fixture."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from millrace.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from millrace.llm.queries import ORACLES, QUERIES, vocabulary_path

FOLDER = os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, Decimal)):
        return str(Decimal(value).normalize())
    return repr(value) if isinstance(value, float) else str(value)


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    sql = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    cursor = sql.execute(ORACLES[name])
    names = [item[0] for item in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_a_row_for_each_document(spark, name):
    table = "embeddings" if name.startswith("op3") else "documents"
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert QUERIES[name](spark, FOLDER).count() == rows


def test_pipeline_stages(spark, frame_of, odd_texts, tmp_path):
    """Every stage works on all rows of the one before, and its decisions take effect."""
    frame = frame_of(odd_texts).select("doc_id", "text", "lang", "source", "n_chars")
    folder = str(tmp_path)
    frame.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i == 8)) for i, _ in odd_texts if i is not None]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(toxicity.training_sample(docs.filter(toxicity.checksum("doc_id") % 3 != 1), spark.read.parquet(f"{folder}/labels.parquet")))
    steps = [
        lambda d: toxicity.keep_acceptable(d, model),
        ngram_join.one_of_each,
        suffix_dedup.strip_repeats,
        mixing.mix,
    ]
    expected = docs
    for (name, stage), step in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        found = stage(spark, expected, folder)
        assert found.columns == docs.columns, name
        expected = step(expected)
        key = ["doc_id", "text", "lang", "source"]
        order = lambda r: tuple((x is None, x or "") if not isinstance(x, int) else (False, str(x)) for x in r)
        got = sorted((tuple(r) for r in found.select(key).collect()), key=order)
        assert got == sorted((tuple(r) for r in expected.select(key).collect()), key=order), name
        assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in found.collect()) or name != "suffix_array_dedup"
    last = corpus_pipeline.run(spark, folder).collect()
    ids = bpe.encode_documents(expected, vocabulary_path(), decode=False).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in last) == sorted((r["id"] or 0, r["ids"]) for r in ids)
