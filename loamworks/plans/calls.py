"""Queries over the calls of a review: what is asked, of which text, and what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import agents
from ..sources import readers
from ..streaming import events as log
from . import rules
from .registry import query, read


@query("SELECT n_regionkey, string_agg('- ' || n_name || ': ' || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'no ' || n_nationkey END, chr(10) ORDER BY n_nationkey) AS catalog FROM nation GROUP BY n_regionkey")
def domain_catalog(spark, sf_dir):
    about = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("no "), F.col("n_nationkey").cast("string")))
    one = F.struct("n_nationkey", F.col("n_name").alias("name"), about.alias("description"))
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(agents.catalog_lines(F.array_sort(F.collect_list(one))).alias("catalog"))


_DOMAINS = ("stability", "impurities", "dissolution")


def _asked(spark, sf_dir) -> DataFrame:
    """Customers as documents, each with three domains; an order is a precedent of the domain that its key names, and not all have a product."""
    names = F.explode(F.array(*map(F.lit, _DOMAINS))).alias("domain")
    domains = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), names)
    domain = F.get(F.array(*map(F.lit, _DOMAINS)), (F.col("o_orderkey") % 4).cast("int"))
    hits = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), domain.alias("domain"), F.col("o_orderkey").alias("rank"), F.concat(F.lit("Text of "), F.col("o_orderkey").cast("string")).alias("deficiency_text"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("product_name"), F.when(F.col("o_orderkey") % 5 != 0, F.lit(0.5)).alias("similarity_score"),
    )
    return agents.by_domain(domains, hits.where("domain IS NOT NULL"))


_ASKED = f"""
d AS (SELECT c_custkey AS doc_id, i, domain FROM customer, (VALUES {", ".join(f"({i}, '{d}')" for i, d in enumerate(_DOMAINS))}) AS n(i, domain)),
h AS (
  SELECT o_custkey AS doc_id, o_orderkey % 4 AS i, o_orderkey, 'Text of ' || o_orderkey AS said, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE '' END AS product, CASE WHEN o_orderkey % 5 <> 0 THEN 0.5 ELSE 0.0 END AS score,
    row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) AS r FROM orders
)
"""


@query(f"""
WITH {_ASKED}
SELECT d.doc_id, domain, count(h.doc_id) AS n, coalesce(string_agg(product || '/' || said, ',' ORDER BY o_orderkey), '') AS said, CAST(coalesce(sum(score), 0) AS DOUBLE) AS score
FROM d LEFT JOIN h ON h.doc_id = d.doc_id AND h.i = d.i GROUP BY 1, 2
""")
def domain_precedents(spark, sf_dir):
    p = F.col("precedents")
    said = F.array_join(F.transform(p, lambda x: F.concat(x["anda_number"], x["product_name"], F.lit("/"), x["deficiency_text"])), ",")
    score = F.aggregate(p, F.lit(0.0), lambda a, x: a + x["similarity_score"])
    return _asked(spark, sf_dir).select("doc_id", "domain", F.size(p).cast("long").alias("n"), said.alias("said"), score.alias("score"))


@query(f"""
WITH {_ASKED},
p AS (SELECT doc_id, i, string_agg('- [' || CASE WHEN product = '' THEN 'unknown' ELSE product END || '] ' || said, chr(10) ORDER BY r) AS lines FROM h WHERE r <= 3 GROUP BY 1, 2),
s AS (SELECT c_custkey AS doc_id, 'A study of ' || CASE WHEN c_custkey % 2 = 0 THEN 'stability' ELSE 'colour' END AS one, 'Table of c' || c_custkey AS two FROM customer)
SELECT 'specialist:' || domain AS source, d.doc_id, md5('Review.' || chr(10) || chr(10) || domain || ': ' || d.i || chr(10) || chr(10) || CASE WHEN lines IS NULL THEN '' ELSE lines || chr(10) || chr(10) END
  || CASE WHEN domain = 'stability' AND d.doc_id % 2 = 0 THEN one ELSE one || chr(10) || chr(10) || '---' || chr(10) || chr(10) || two END) AS prompt
FROM d JOIN s ON s.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id AND p.i = d.i
""")
def specialist_prompts(spark, sf_dir):
    """A document's two sections: every other one mentions a domain in the first, which is then all that its specialist reads."""
    first = F.concat(F.lit("A study of "), F.when(F.col("c_custkey") % 2 == 0, "stability").otherwise("colour"))
    texts = F.array(first, F.concat(F.lit("Table of c"), F.col("c_custkey").cast("string")))
    sections = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(texts).alias("section_ord", "text")).withColumns({"heading": F.lit(""), "rendered": F.col("text")})
    place = F.array_position(F.array(*map(F.lit, _DOMAINS)), F.col("domain")) - 1
    work = agents.specialist_work(_asked(spark, sf_dir).withColumn("description", place.cast("string")), sections, "Review.")
    return work.select("source", "doc_id", F.md5("prompt").alias("prompt"))


@query("""
SELECT l_orderkey AS doc_id, l_linenumber, 'reviewer:' || l_returnflag AS source, 'Line of ' || CAST(l_quantity AS INTEGER) AS title, 'high' AS severity, 'model_judgment' AS evidence_class, 'advisory' AS tier, 0 AS precedents, CAST(1 AS INTEGER) AS ord
FROM lineitem WHERE l_quantity >= 10 AND l_returnflag <> 'N'
""")
def stamped_findings(spark, sf_dir):
    """A line's answer has a finding without a title and one with blanks around it; calls of one kind of line failed."""
    df = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'X'")
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    title = F.when(F.col("l_quantity") >= 10, F.concat(F.lit("  Line of "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "))).otherwise(" ")
    found = F.array(F.struct(F.lit("").alias("title"), F.lit("low").alias("severity")), F.struct(title.alias("title"), F.lit("high").alias("severity")))
    answer = F.when(F.col("l_returnflag") != "N", F.to_json(F.struct(found.alias("findings"))))
    answers = df.select(key.alias("item_id"), answer.alias("result"))
    work = df.select(key.alias("item_id"), F.lit("?").alias("prompt"), F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.concat(F.lit("reviewer:"), "l_returnflag").alias("source"), F.array().alias("precedents"))
    return agents.faults(answers, work).select("doc_id", "l_linenumber", "source", "title", "severity", "evidence_class", "tier", F.size("precedents").alias("precedents"), "ord")


@query(f"""
WITH f AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderkey % 3 AS kind, o_orderstatus AS s FROM orders),
x AS (SELECT repeat('word ', 2900) AS w)
SELECT doc_id, ord, md5('Refute.' || chr(10) || 'Finding: F' || ord || chr(10) || 'Why: ' || chr(10) || 'Quoted: ' || s || chr(10) || 'From the document:' || chr(10)
  || CASE kind WHEN 0 THEN w || '1' WHEN 1 THEN w || '2' ELSE w || '1' || b || w || '2' || b || chr(10) || '[... further sections omitted for length ...]' END) AS prompt
FROM f, x, (SELECT chr(10) || chr(10) || '---' || chr(10) || chr(10) AS b)
""")
def challenge_prompts(spark, sf_dir):
    """A finding names a section's table, its heading or nothing; without either its challenger reads all three sections, as far as they fit."""
    three = F.array(*[F.struct(F.lit(i).alias("section_ord"), F.lit(h).alias("heading"), F.lit(t).alias("title")) for i, h, t in ((1, "Results", "Table 1 a"), (2, "Data", ""), (3, "Methods", ""))])
    sections = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(three))
    sections = sections.withColumn("rendered", F.concat(F.repeat(F.lit("word "), F.lit(2900)), F.col("section_ord").cast("string")))
    kind = F.col("o_orderkey") % 3
    findings = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("title"), F.lit(None).cast("string").alias("detail"),
        F.col("o_orderstatus").alias("evidence"), F.when(kind == 0, "Table 1").alias("table_ref"), F.when(kind == 1, "DATA").alias("section"),
    )
    return agents.challenge_work(findings, sections, sections, "Refute.").select("doc_id", "ord", F.md5("prompt").alias("prompt"))


@query("""
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0
""")
def zipped_rows(spark, sf_dir):
    """Rows that come as arrays of values beside an array of names; those of another length are no rows."""
    values = F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")))
    values = F.when(F.col("o_orderkey") % 7 == 0, F.slice(values, 1, 1)).otherwise(values)
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.array(F.lit("key"), F.lit("status")).alias("names"), values.alias("values"))
    row = readers.zipped(F.col("names"), F.col("values"))
    return df.select("o_orderkey", row.alias("row")).where("row IS NOT NULL").select("o_orderkey", F.col("row")["key"].alias("key"), F.col("row")["status"].alias("status"))


@query(f"""
WITH {rules._STREAM}, c AS (SELECT user_id, min(event_id) AS last FROM e WHERE event_type = 'pipeline_complete' GROUP BY user_id)
SELECT CAST(e.user_id AS VARCHAR) AS job_id, event_type, CAST(event_id AS VARCHAR) AS message FROM e LEFT JOIN c ON c.user_id = e.user_id WHERE last IS NULL OR event_id <= last
UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'connected', NULL FROM e
""")
def watched_jobs(spark, sf_dir):
    return log.watched(rules.job_events(read(spark, sf_dir, "events"))).select("job_id", "event_type", "message")
