"""The registered queries against their SQL, and the pipeline stage by stage, on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import database, difference
from visledger.llm import queries
from visledger.llm.mixing import word_count

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), database(SF), queries.SQL[name]) == ""


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SF)
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        seen.append(out)
    known, single, clean, mixed, tokens = seen[1:]
    assert known.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    comps = queries.simhash.near_duplicates(known).where("doc_id = component_id").select("doc_id")
    assert sorted(r[0] for r in comps.collect()) == sorted(r[0] for r in single.select("doc_id").collect())
    found = queries.decontam.summary(queries.decontam.find_overlap(single, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert sorted(r[0] for r in found.where("not contaminated").select("doc_id").collect()) == sorted(r[0] for r in clean.select("doc_id").collect())
    assert mixed.join(clean, "doc_id", "left_anti").count() == 0 and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    before, after = (d.select(F.sum(word_count(F.col("text")))).first()[0] for d in (clean, mixed))
    assert abs(before - after) < 0.02 * before
    assert tokens.count() == mixed.count()


def test_pipeline_runs_whole(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_queries_on_whole_tables_match_their_contracts(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_mixing", "op2_toxicity", "op6_language"):
        assert queries.QUERIES[name](spark, SF).count() == n
    tox = queries.op2_toxicity(spark, SF)
    assert tox.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
