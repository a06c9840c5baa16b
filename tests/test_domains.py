from pyspark.sql import functions as F

from loamworks.operators import domains, retrieval


def test_domains(spark):
    df = spark.createDataFrame([("Stability of leachable metal", None), ("nothing", 'so ["stability", "bogus", " stability ", "impurities"]'), ("", "[broken")], "said string, answer string")
    known = ["stability", "impurities", "specification"]
    assert [r[0] for r in df.select(domains.fallback(F.col("said"))).collect()][0] == ["elemental-impurities", "stability", "container-closure"]
    got = [r[0] for r in df.select(domains.chosen(F.col("answer"), F.col("said"), known)).collect()]
    assert got[1] == ["stability", "impurities"] and got[2] == ["specification", "method-validation", "impurities"]


def test_scope_and_context(spark):
    sections = spark.createDataFrame([("d", 1, "1 Stability", "shelf"), ("d", 2, "2 Other", "x"), ("d", 3, "3 Impurities", "y")], "doc_id string, section_ord int, heading string, text string")
    asked = spark.createDataFrame([("d", "stability"), ("d", "nitrosamines")], "doc_id string, domain string")
    got = {(r.domain, r.section_ord) for r in domains.scope(asked, sections).collect()}
    assert got == {("stability", 1), ("nitrosamines", 1), ("nitrosamines", 2), ("nitrosamines", 3)}
    titles = spark.createDataFrame([("d", 1, "Table 11 a"), ("d", 2, "Table 12 b")], "doc_id string, section_ord int, title string")
    findings = spark.createDataFrame([("d", 1, "Table 11", ""), ("d", 2, "", "impurities"), ("d", 3, "", "")], "doc_id string, ord long, table_ref string, section string")
    got = {(r.ord, r.section_ord, r.way) for r in domains.context(findings, sections, titles).collect()}
    assert got == {(1, 1, 0), (2, 3, 1), (3, 1, 2), (3, 2, 2), (3, 3, 2)}


def test_search(spark):
    kb = spark.createDataFrame([(1, "stability data missing", "p", "s"), (2, "impurity limit", "q", "t")], "kb_id long, deficiency_text string, product_name string, cmc_section string")
    vectors = kb.select("kb_id", retrieval.hash_embedding(F.col("deficiency_text")).alias("embedding"))
    q = spark.createDataFrame([("impurity limit",)], "t string").select(retrieval.hash_embedding(F.col("t"))).first()[0]
    assert [r.kb_id for r in retrieval.search(vectors, kb, q, "", 2).collect()][0] == 2
    assert [r.kb_id for r in retrieval.search(vectors.limit(0), kb, q, "the stability", 2).collect()] == [1]
