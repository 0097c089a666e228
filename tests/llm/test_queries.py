"""The registered queries run on the smallest tables, and the pipeline agrees with its parts worked one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provenant.llm import langid, lines, mixing, queries, simhash
from provenant.llm.common import stored
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    number = name.split("_")[0]
    if number == "op11":  # rows of phrases, not of documents
        assert oracle.check(df, oracle.connect(sf_dir), queries.ORACLES[name]) > 0
        return
    table, key = {"op1": ("pages", "page_id"), "op2": ("embeddings", "vec_id"), "op13": ("embeddings", "vec_id")}.get(number, ("documents", "doc_id"))
    ids = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)
    assert df.select(key).distinct().exceptAll(ids).count() == 0
    assert df.select(key).distinct().count() == ids.count()
    if number not in ("op3", "op12"):
        assert df.count() == ids.count() * (32 if number == "op13" else 1)
    if name in queries.ORACLES:
        oracle.check(df, oracle.connect(sf_dir), queries.ORACLES[name])


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(
        spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "123", "en", "src0", 3)], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs, _ = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = (before, docs)
    before, after = kept["language ID"]
    assert {r[0] for r in before.select("doc_id").exceptAll(after.select("doc_id")).collect()} == {-1, -2}
    before, after = kept["line dedup"]
    want = lines.remove_repeats(before).where("n_lines_removed = 0 OR trim(text) <> ''").select("doc_id", "text")
    assert want.exceptAll(after.select("doc_id", "text")).count() == 0 and after.count() == want.count()
    before, after = kept["SimHash near-dedup"]
    heads = {r[0] for r in simhash.near_duplicates(before).select("component_id").distinct().collect()}
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(heads)
    before, after = kept["source mixing"]
    sizes = before.select("doc_id", "source", mixing.n_words().alias("size"))
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(sizes).collect()}
    got = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.sum(mixing.n_words()).alias("n")).collect()}
    assert {k: v for k, v in want.items() if v} == got
    done = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    lengths = done.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert lengths.where("n <> end OR n > 4096").count() == 0
    assert done.select("doc_id", "copy").distinct().count() == docs.count()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert langid.UNDETERMINED not in [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").distinct().collect()]
