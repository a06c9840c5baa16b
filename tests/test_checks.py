import json

import pytest
from pyspark.sql import functions as F

from loamworks.operators import checks, ranking
from loamworks.sources.readers import DOCUMENT, FINDING


def doc(spark, doc_id="d", blocks=(), tables=(), filename="f.pdf", pages=None):
    pages = pages or [{"page_number": 1, "blocks": [{"text": b, "page": 1} for b in blocks], "tables": list(tables)}]
    row = json.dumps({"doc_id": doc_id, "filename": filename, "page_count": len(pages), "pages": pages})
    return spark.createDataFrame([(row,)], "j string").select(F.from_json("j", DOCUMENT).alias("d")).select("d.*")


def grid(headers, rows, title="", page=1):
    return {"kind": "grid", "headers": headers, "rows": rows, "title": title, "page": page}


def test_result_against_limit(spark):
    rows = [["Assay", "97.4 %", "98.0 – 102.0"], ["Water", "1,250", "not more than 1300"], ["Residue", "ND", "NMT 0.1"], ["pH", "4.1", None], ["Yield", "< 80", ">= 85"], ["short"], ["Assay, again", "98.0", "98.0 to 102.0"]]
    got = checks.result_vs_limit(doc(spark, tables=[grid(["Test", "Observed", "Acceptance criteria"], rows, page=3)])).collect()
    assert [r.evidence for r in got] == ["Assay | 97.4 % | 98.0 – 102.0", "Yield | < 80 | >= 85"]
    assert {(r.tier, r.evidence_class, r.severity) for r in got} == {("verified", "code_verified", "high")}
    assert checks.result_vs_limit(doc(spark, tables=[grid(["Test", "Area"], [["a", "9"]])])).count() == 0


def test_inline_limit(spark):
    rows = [["Plates", "1,900 (NLT 2000)"], ["Drift", "0.4\n(not more than 0.5)"], ["Recovery", "103 (95-105) (n=3)"], ["Blank", None], ["Note", "(max 3)"], ["Noise", "7 (max 3)"]]
    got = checks.value_vs_inline_limit(doc(spark, tables=[grid(["What", "Found"], rows)])).collect()
    assert sorted(r.title.split(":")[0] for r in got) == ["Noise", "Plates"]


def test_conflicting_thresholds(spark):
    pages = [{"page_number": 2, "blocks": [{"text": "An AET of 3.5 µg/patch is used."}]}, {"page_number": 9, "blocks": [{"text": "The aet,"}, {"text": "as agreed, is 4.25 ug / patch."}]}, {"page_number": 11, "blocks": [{"text": "AET: 3.51 µg/patch"}]}]
    got = checks.conflicting_thresholds(doc(spark, pages=pages)).collect()
    assert [r.evidence for r in got] == ["3.5 µg/patch (p.2), 4.25 µg/patch (p.9)"]  # 3.51 lies within a hundredth of 3.5
    units = [{"page_number": 1, "blocks": [{"text": "AET 12 µg/g"}, {"text": "AET 3 µg/patch"}]}]
    assert checks.conflicting_thresholds(doc(spark, pages=units)).count() == 0


def test_missing_elements(spark):
    said = "3.2.P.4.3 Accuracy, repeatability and LOD were shown; standards kept: solution stability. System suitability passed."
    titles = [r.title.rsplit("address ", 1)[1] for r in checks.missing_elements(doc(spark, blocks=[said])).collect()]
    assert titles == ["specificity", "linearity", "limit of quantitation (LOQ)", "robustness / ruggedness"]
    assert checks.missing_elements(doc(spark, blocks=["3.2.P.7 closures"], filename="3.2.S.4.2.pdf")).count() == 0
    assert checks.missing_elements(doc(spark, filename="report 3.2.S.4.2.pdf")).count() == 9


def test_component_coverage_and_commitment(spark):
    rows = [["Backing film", "cytotoxicity"], [None, "USP <88> passed"], ["Pouch", "identity"], ["Release liner", "USP <88>"]]
    d = doc(spark, blocks=["Leachable and extractable profile."], tables=[grid(["Part", "Done"], rows, "Materials"), grid(["Part", "Done"], [["Pouch", "USP <88>"]], "Others")])
    assert [r.title for r in checks.component_coverage(d).collect()] == ["USP <88> not performed for Pouch"]  # another title, another list
    assert checks.missing_commitment(d).count() == 1
    for said in ("Ongoing monitoring is planned.", "Monitored amounts stay low; we monitor them to the end of shelf life.", "The firm will continue\nto monitor."):
        assert checks.missing_commitment(doc(spark, blocks=["Extractable and leachable study.", said])).count() == 0


def test_one_failing_check_leaves_the_others(spark, tmp_path):
    d = doc(spark, blocks=["Extractable and leachable study."])

    def planned(docs):
        return docs.select("no_such_column")

    def running(docs):
        return checks.missing_commitment(docs).withColumn("title", F.raise_error(F.lit("broken")).cast("string"))

    def keep(found):
        path = f"{tmp_path}/{found._jdf.hashCode()}"
        found.write.parquet(path)
        return spark.read.parquet(path)

    with pytest.warns(UserWarning, match="failed"):
        assert checks.run(d, [planned, checks.missing_commitment]).count() == 1
    with pytest.warns(UserWarning, match="failed"):
        assert checks.run(d, [running, checks.missing_commitment], keep).count() == 1
    with pytest.warns(UserWarning, match="failed"):
        assert checks.run(d, [planned]).count() == 0


def test_empty_documents(spark):
    d = spark.createDataFrame([("e", None, 0, None, None)], DOCUMENT)
    assert checks.run(d).count() == 0
    assert checks.run(d.limit(0)).count() == 0


def finding(**x):
    base = {"doc_id": "d", "ord": 1, "title": "t", "evidence": "", "severity": "medium", "tier": "advisory", "evidence_class": "model_judgment", "confidence": 0.0, "precedents": []}
    return base | x


def findings(spark, *rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", FINDING).alias("f")).select("f.*")


PRECEDENT = [{"anda_number": "1", "product_name": "p", "deficiency_text": "x", "similarity_score": 0.9}]


def test_verify_and_tier(spark):
    corpus = spark.createDataFrame([("d", "theassaywas99%")], "doc_id string, corpus string")
    rows = [
        finding(ord=1, title="a", evidence="The assay was 99%", precedents=PRECEDENT),
        finding(ord=2, title="b", evidence="not in it"),
        finding(ord=3, title="C x", evidence="abc", precedents=PRECEDENT),
        finding(ord=4, title="cX", tier="verified", evidence_class="code_verified", severity="high", confidence=0.95),
    ]
    got = {r.title: r for r in ranking.verify_and_tier(findings(spark, *rows), corpus).collect()}
    assert set(got) == {"a", "b", "cX"}
    assert (got["a"].tier, got["a"].evidence_class, got["a"].confidence) == ("corroborated", "quote_anchored", 0.6)
    assert (got["b"].tier, got["b"].confidence, got["b"].novel) == ("advisory", 0.3, True)
    assert got["cX"].rank == 1 and len(got["cX"].precedents) == 1
    verdicts = spark.createDataFrame([("d", 1, True, "assay was 99%"), ("d", 2, True, "never said")], "doc_id string, ord long, refuted boolean, counter_evidence string")
    after = {r.title: r for r in ranking.challenge(ranking.verify_and_tier(findings(spark, *rows), corpus), verdicts, corpus).collect()}
    assert after["a"].confidence == pytest.approx(0.24) and after["a"].tier == "advisory" and after["a"].challenge_note
    assert after["b"].confidence == pytest.approx(0.4) and after["b"].challenge_note == "" and after["cX"].confidence == 0.95
    out = ranking.report(ranking.challenge(ranking.verify_and_tier(findings(spark, *rows), corpus), verdicts, corpus)).first().report
    assert json.loads(out)["faults_found"] and len(json.loads(out)["faults"]) == 3
