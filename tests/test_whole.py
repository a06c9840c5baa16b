"""Queries over whole tables where the small ones do not show a cut: against their SQL on tables made here."""

import os
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loamworks.operators import retrieval
from loamworks.plans import catalog

from .test_catalog import rows


def same(spark, path, name):
    """The rows of a query over the tables under a path, which are those of its SQL."""
    duck = duckdb.connect()
    for f in os.listdir(path):
        duck.sql(f"create view {f.split('.')[0]} as select * from '{path}/{f}/*.parquet'")
    df, want = catalog.QUERIES[name](spark, str(path)), duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = df.collect()
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    return got


def put(spark, path, name, data, schema):
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")


@pytest.mark.parametrize("n", [0, 1, 97])
def test_findings_of_all_passages(spark, tmp_path, n):
    put(spark, tmp_path, "benchmark", [(i * 3, f"passage no {i} of many") for i in range(n)], "item_id long, text string")
    said = lambda d: f"So: Passage no {d * 3 % n} of MANY." if n else None
    put(spark, tmp_path, "documents", [(d, said(d)) for d in range(60)], "doc_id long, text string")
    got = same(spark, tmp_path, "verified_findings")
    assert len(got) == (180 if n else 0)
    assert all(r.evidence_class == "quote_anchored" for r in got if r.ord == 0)


def vectors(n, first=0, seed=1):
    r = random.Random(seed)
    few = [[r.choice([-0.5, 0.25, 1.0, 0.1]) for _ in range(5)] for _ in range(n // 2)]
    return [(first + i, few[i % len(few)] if i % 9 else None) for i in range(n)]  # copies tie


def test_search_of_all_vectors(spark, tmp_path):
    put(spark, tmp_path, "embeddings", vectors(120), "vec_id long, embedding array<float>")
    got = same(spark, tmp_path, "cosine_topk_batch")
    assert {r.query_id for r in got} == {i for i in range(0, 120, 20) if i % 9}


@pytest.mark.parametrize("how", [{}, {"shard_rows": 16, "block_rows": 7}])
def test_search_in_blocks(spark, how):
    data = [*vectors(90), (200, [1.0, None, 0.0, 0.0, 0.0]), (201, [1.0]), (202, [0.0] * 5), (203, [float("nan")] * 5)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).where("query IS NOT NULL")
    one, two = F.col("embedding"), F.col("query")
    score = retrieval.dot(one, two) / ((retrieval.norm(one) + F.lit(1e-9)) * (retrieval.norm(two) + F.lit(1e-9)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    plain = df.where("embedding IS NOT NULL").crossJoin(q).select("query_id", "vec_id", score.alias("score")).withColumn("rank", rank).where("rank <= 4")
    got = retrieval.cosine_topk_batch(df, q, 4, **how).select("query_id", "vec_id", "score", "rank").collect()
    assert sorted(map(str, got)) == sorted(map(str, plain.collect()))


def test_search_without_first_vector(spark, tmp_path):
    put(spark, tmp_path, "embeddings", vectors(20, first=5), "vec_id long, embedding array<float>")
    put(spark, tmp_path, "documents", [(7, "en", "web", 1)], "doc_id long, lang string, source string, n_chars long")
    assert same(spark, tmp_path, "cosine_topk") == []
    assert same(spark, tmp_path, "topk_join") == []


def test_headings_of_all_parts(spark, tmp_path):
    put(spark, tmp_path, "part", [(i, 1 + i // 10 % 6, f"p{i}") for i in range(1, 300) if i % 7], "p_partkey long, p_size long, p_name string")
    got = same(spark, tmp_path, "heading_match")
    assert len(got) == 60  # every number, though no part is divisible by 7


def test_activity_of_all_jobs(spark, tmp_path):
    kinds = ["signup", "view", "purchase", "error"]
    put(spark, tmp_path, "events", [(i, 100 + i % 6, kinds[i % 4], float(i * 3)) for i in range(120)], "event_id long, user_id long, event_type string, value double")
    assert {r.job_id for r in same(spark, tmp_path, "shown_activity")} == {str(100 + i) for i in range(6)}
    assert {r.user_id for r in same(spark, tmp_path, "event_isolation")} == set(range(100, 106))
