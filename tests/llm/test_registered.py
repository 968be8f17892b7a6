import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from defectlake.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@here
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{FOLDER}/{t}'")
    want = c.sql(SQL[name]).fetchdf()
    columns = sorted(want.columns)
    sort = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert sort(QUERIES[name](spark, FOLDER).toPandas()).equals(sort(want))


@here
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op3_language"](spark, FOLDER).join(docs, "doc_id").filter("held_out and lang_pred <> 'und'")
    r = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r["a"] >= 0.95


@here
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        m = docs.count()
        assert n * 0.5 < m <= n
        n = m
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == n
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
