"""Composed calls: work items, answers, defaults and failures."""

import json

import pytest
from pyspark.sql import functions as F

from loamworks.operators import agents, model_calls
from loamworks.sources import readers
from loamworks.streaming import events as log

SECTIONS = "doc_id string, section_ord int, heading string, text string, rendered string"


def answering(answer):
    def client():
        return lambda prompt, tokens: answer

    return client


def test_specialists_and_reviewers(spark):
    sections = spark.createDataFrame([("a", 1, "Stability", "data", "## S"), ("a", 2, "Other", None, "## O"), ("b", 1, None, None, None)], SECTIONS)
    domains = spark.createDataFrame([("a", "stability", "how long"), ("b", "stability", None)], "doc_id string, domain string, description string")
    hits = spark.createDataFrame([("a", "stability", 2, "second"), ("a", "stability", 1, None)], "doc_id string, domain string, rank int, deficiency_text string")
    lists = agents.by_domain(domains, hits)
    got = {r.doc_id: r.precedents for r in lists.collect()}
    assert [tuple(p) for p in got["a"]] == [("", "", "", 0.0), ("", "", "second", 0.0)] and got["b"] == []
    work = agents.specialist_work(lists, sections, "Review.").cache()
    said = {r.doc_id: r.prompt for r in work.collect()}
    assert "## S" in said["a"] and "## O" not in said["a"] and "[unknown] second" in said["a"]
    assert said["b"].startswith("Review.\n\nstability: ")
    answers = model_calls.fan_out(work, answering('{"findings": [{"title": " t ", "severity": "low"}, {"title": ""}]}'), ("findings",), wait=0.0)
    rows = agents.faults(answers, work).collect()
    assert {(r.doc_id, r.title, r.source, r.tier, r.evidence_class, len(r.precedents)) for r in rows} == {("a", "t", "specialist:stability", "advisory", "model_judgment", 2), ("b", "t", "specialist:stability", "advisory", "model_judgment", 0)}
    groups = sections.withColumn("group_id", F.lit(7))
    assert {(r.source, len(r.precedents)) for r in agents.reviewer_work(groups, "Look.").collect()} == {("reviewer:7", 0)}


def test_challengers(spark):
    sections = spark.createDataFrame([("a", 1, "Stability", "", "## S"), ("a", 2, "Other", "", "## O")], SECTIONS).withColumn("title", F.lit(None).cast("string"))
    found = spark.createDataFrame([("a", 0, "T", None, "e", None, "other"), ("a", 1, None, "d", None, None, None), ("z", 2, "Z", "", "", "", "")], "doc_id string, ord int, title string, detail string, evidence string, table_ref string, section string")
    said = {r.ord: r.prompt for r in agents.challenge_work(found, sections, sections, "Refute.").collect()}
    assert "## O" in said[0] and "## S" not in said[0]
    assert "## O" in said[1] and "## S" in said[1]
    assert said[2].endswith("From the document:\n")


def test_sections_are_never_broadcast(spark):
    """The size that Spark guesses for texts made from narrow columns is far below theirs: a broadcast of many of them ends in an error."""
    sections = spark.range(3).select(F.col("id").cast("string").alias("doc_id"), F.lit(1).alias("section_ord"), F.lit("Data").alias("heading"), F.lit("Table 1 a").alias("title"), F.repeat(F.lit("word "), F.lit(5000)).alias("rendered"))
    found = spark.createDataFrame([("0", 0, "T", None, "e", "Table 1", None), ("1", 1, "T", None, "e", None, "data"), ("2", 2, "T", None, "e", None, None)], "doc_id string, ord int, title string, detail string, evidence string, table_ref string, section string")
    work = agents.challenge_work(found, sections, sections, "Refute.")
    assert [len(r.prompt) > 25_000 for r in work.collect()] == [True] * 3
    joins = [x.strip(" :+-*") for x in work._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [doc_id#" in x]
    assert joins and not [x for x in joins if "Broadcast" in x and "ord#" not in x]  # those with ord have no sections


@pytest.mark.parametrize("answer, want", [('["stability", "none such"]', ["stability"]), ("no idea", ["impurities"])])
def test_selector(spark, answer, want):
    docs = spark.createDataFrame([("a", None, ["H", None], "Impurities of it")], "doc_id string, filename string, headings array<string>, said string")
    catalog = agents.catalog_lines(F.array(F.struct(F.lit("stability").alias("name"), F.lit(None).cast("string").alias("description"))))
    work = agents.selector_work(docs, catalog, "Pick.")
    assert "- stability: \n" in work.first().prompt
    answers = model_calls.fan_out(work, answering(answer), (), wait=0.0)
    assert [r.domains for r in agents.selected(work, answers, ["stability", "impurities"]).collect()] == [want]
    assert [r.domains for r in agents.selected(work, answers.limit(0), ["stability"]).collect()] == [["impurities"]]


def test_log_tables_and_health(spark, tmp_path):
    assert readers.qualified("t", "c", "s`x") == "`c`.`s``x`.`t`" and readers.qualified("t") == "`t`"
    path = str(tmp_path / "log")
    at = [("j", "parse", "shown", 1), ("j", "parse", "pipeline_complete", 2), ("j", "parse", "late", 3), ("k", "parse", "shown", None)]
    rows = spark.createDataFrame(at, "job_id string, layer string, event_type string, s long")
    rows = rows.select("job_id", "layer", "event_type", F.lit(None).cast("string").alias("agent_name"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("map<string, string>").alias("metadata"), F.timestamp_seconds("s").alias("at"))
    log.publish(rows.limit(2), path)
    log.publish(rows.where("event_type = 'late' OR job_id = 'k'"), path)
    got = log.watched(spark.read.schema(log.EVENT).parquet(path))
    assert sorted((r.job_id, r.event_type) for r in got.collect()) == [("j", "connected"), ("j", "pipeline_complete"), ("j", "shown"), ("k", "connected"), ("k", "shown")]

    def broken():
        raise OSError("gone")

    assert readers.health({"store": lambda: spark.sql("SELECT 1").collect()}) == {"store": "up", "status": "ok"}
    assert readers.health({"model": broken}) == {"model": "down: OSError", "status": "degraded"}
    assert json.dumps(spark.range(1).select(readers.zipped(F.array(F.lit("a")), F.array(F.lit(1), F.lit(2))).alias("m")).first().m) == "null"


def test_replace_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE replaced LOCATION 'file://{tmp_path}/db'")
    try:
        name = readers.qualified("t", "", "replaced")
        readers.replace_table(spark.range(5), name)
        readers.replace_table(spark.createDataFrame([("a",)], "other string"), name)
        assert [tuple(r) for r in spark.table(name).collect()] == [("a",)]
    finally:
        spark.sql("DROP DATABASE replaced CASCADE")
