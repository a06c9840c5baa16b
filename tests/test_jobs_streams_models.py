import datetime as dt
import json

from loamworks.operators import jobs, model_calls
from loamworks.sources import readers
from loamworks.streaming import events


def test_job_log(spark):
    log = jobs.entry(spark, "a", 1, "accepted", "t1", "f.pdf").unionByName(jobs.entry(spark, "a", 2, "parsing", "t2", flaw_report='{"faults": [{"title": "x"}]}')).unionByName(jobs.entry(spark, "a", 3, "complete", "t3", other="no"))
    r = jobs.latest(log).first()
    assert (r.status, r.document_name, r.completed_at, r.created_at) == ("complete", "f.pdf", "t3", "t1")
    assert jobs.result(log, "a").first().faults == [{"title": "x"}]
    assert jobs.result(log, "none").count() == 0


def test_streams(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    kinds = ["stage_started", "layer_complete", "pipeline_complete", "too_late"]
    rows = [(j, "parse", k, "", f"{j}{i}", {}, at + dt.timedelta(seconds=i)) for j in "ab" for i, k in enumerate(kinds)]
    spark.createDataFrame(rows, events.EVENT).write.parquet(str(tmp_path / "in"))
    stream = events.source(spark, str(tmp_path / "in"))
    q = events.until_complete(events.subscribe(stream, "a")).writeStream.format("memory").queryName("until").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("until").collect()
    assert {r.job_id for r in got} == {"a"} and [r.event_type for r in got] == kinds[:3]
    p = events.progress(spark.createDataFrame(rows, events.EVENT)).where("job_id = 'b'").first()
    assert p.done and p.events == 3
    raw = spark.createDataFrame([('{"job_id": "a", "layer": "parse", "event_type": "x"}',), ("{broken",), ('{"job_id": "a"}',)], "value string")
    assert events.decode(raw).count() == 1


def test_model_calls(spark):
    def client():
        def call(prompt, tokens):
            if prompt == "down":
                raise model_calls.Retryable("busy")
            if prompt == "bug":
                raise ValueError("bad")
            return {"good": '{"findings": [{"title": " a "}, {"title": " "}]}', "fenced": 'see\n```json\n{"findings": []}\n```', "broken": '{findings: [{"title": "b",}', "empty": "", "other": '{"x": 1}'}[prompt]

        return call

    names = ["good", "fenced", "broken", "empty", "other", "down", "bug"]
    work = spark.createDataFrame(list(enumerate(names)), "item_id long, prompt string")
    got = {names[r.item_id]: r for r in model_calls.fan_out(work, client, ("findings",), wait=0.0).collect()}
    assert all((r.result is None) != (r.reason is None) for r in got.values())
    assert {n for n, r in got.items() if r.result} == {"good", "fenced", "broken"}
    assert json.loads(got["broken"].result) == {"findings": [{"title": "b"}]}
    answers = model_calls.fan_out(work, client, ("findings",), wait=0.0)
    assert sorted(r.title for r in model_calls.findings(answers, work).collect()) == ["a", "b"]
    assert model_calls.failures(answers).count() == 4


def test_knowledge_base(spark):
    df = spark.createDataFrame([("1", "P", "text", None), (None, None, None, None)], "`ANDA #` string, `Product Name` string, Deficiency string, `My Note` string")
    out = readers.kb(df)
    assert out.columns == ["anda_number", "product_name", "deficiency_text", "my_note"] and out.count() == 1
    assert readers.kb_name("Deficiency Response") == "deficiency_response"
