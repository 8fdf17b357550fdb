"""Registered training-data queries: SQL where there is some, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from meterline.llm.queries import QUERIES, SQL
from tests.conftest import SF
from tests.test_queries import plain


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    cursor = connection.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    assert plain([r.asDict() for r in got.collect()], columns) == plain([dict(zip(names, r)) for r in cursor.fetchall()], columns)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, columns = {r.doc_id for r in docs.select("doc_id").collect()}, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept and kept <= ids
        assert name == "packing" or docs.columns == columns
        ids = kept
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 1024


def test_pipeline_stages_on_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, "x", 1), (1, "", None, 2), (1, "", None, 2), (2, "a " * 500, "s", 3), (3, "a " * 500, "s", 4)],
                                "doc_id long, text string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        stage(spark, odd, SF).collect()
    assert sorted(str(r.doc_id) for r in corpus_pipeline.distinct(spark, odd, SF).collect()) == ["1", "2", "None"]


def test_distinct_tells_rows_apart_by_id_and_text(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    docs = spark.createDataFrame([(7, one), (7, two), (7, two), (8, two), (None, three), (None, three), (None, one), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(7, one), (7, two), (None, three), (3, "")], key=str)
