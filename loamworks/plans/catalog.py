"""Queries over the driver's tables, one for each relational operator, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import jobs, ranking, retrieval, sequences, training
from . import calls, documents, layouts, rules  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL, query, read  # noqa: F401

@query(r"""
WITH t AS (
  SELECT l_orderkey, l_linenumber, l_discount AS value,
    CASE l_returnflag WHEN 'R' THEN 'NMT 0.05' WHEN 'A' THEN 'NLT 0.02' ELSE '0.01 - 0.08' END AS limit_text FROM lineitem
), p AS (
  SELECT *, CASE WHEN limit_text LIKE 'NMT%' THEN 'max' WHEN limit_text LIKE 'NLT%' THEN 'min' ELSE 'range' END AS kind,
    list_transform(regexp_extract_all(limit_text, '\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE)) AS n FROM t
)
SELECT l_orderkey, l_linenumber, value, limit_text, kind FROM p
WHERE (kind = 'max' AND value > n[1]) OR (kind = 'min' AND value < n[1]) OR (kind = 'range' AND (value < n[1] OR value > n[2]))
""")
def limit_violations(spark, sf_dir):
    said = F.when(F.col("l_returnflag") == "R", "NMT 0.05").when(F.col("l_returnflag") == "A", "NLT 0.02").otherwise("0.01 - 0.08")
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.number(F.col("l_discount").cast("string")).alias("value"), said.alias("limit_text"))
    df = df.withColumn("lim", text.limit(F.col("limit_text"))).where(~text.satisfies(F.col("value"), F.col("lim")))
    return df.select("l_orderkey", "l_linenumber", "value", "limit_text", F.col("lim.kind").alias("kind"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity AS value, 40.0::DOUBLE AS high FROM lineitem WHERE l_quantity > 40
""")
def inline_limit_violations(spark, sf_dir):
    cell = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("\n(NMT 40)"))
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell")).select("l_orderkey", "l_linenumber", F.explode(text.broken(*text.inline(F.col("cell")))).alias("x"))
    return df.select("l_orderkey", "l_linenumber", "x.value", F.col("x.lim.high").alias("high"))


@query("""
WITH v AS (SELECT p_brand, list_sort(list_distinct(list(round(p_retailprice, 3)))) AS v FROM part GROUP BY p_brand),
r AS (
  SELECT p_brand, list_reduce(list_transform(v, lambda x: {'k': [x]}),
    lambda a, x: CASE WHEN len(list_filter(a.k, lambda k: abs(x.k[1] - k) <= greatest(0.001, 0.01 * k))) > 0 THEN a ELSE {'k': list_concat(a.k, x.k)} END).k AS k FROM v
)
SELECT p_brand, len(k) AS n_values, k[1] AS first_value, k[len(k)] AS last_value FROM r WHERE len(k) >= 2
""")
def conflicting_values(spark, sf_dir):
    # Distinct rounded values are few: they are what is gathered, not the rows.
    df = read(spark, sf_dir, "part").select("p_brand", F.round("p_retailprice", 3).alias("v")).groupBy("p_brand").agg(F.collect_set("v").alias("v"))
    df = df.withColumn("k", text.collapse_near(F.col("v"))).where(F.size("k") >= 2)
    return df.select("p_brand", F.size("k").cast("long").alias("n_values"), F.get("k", F.lit(0)).alias("first_value"), F.get("k", F.size("k") - 1).alias("last_value"))


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), k AS (SELECT DISTINCT event_type FROM events)
SELECT user_id, CAST(day AS VARCHAR) AS day, event_type FROM d, k
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.user_id AND CAST(e.ts AS DATE) = d.day AND e.event_type = k.event_type)
""")
def missing_elements(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    have = events.groupBy("user_id", "day").agg(F.collect_set("event_type").alias("have"))
    kinds = events.agg(F.collect_set("event_type").alias("kinds"))  # one row, a closed set of kinds
    return have.join(F.broadcast(kinds)).select("user_id", F.col("day").cast("string").alias("day"), F.explode(F.array_except("kinds", "have")).alias("event_type"))


@query("""
WITH f AS (
  SELECT user_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'view') THEN event_type END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS component FROM events
), g AS (SELECT user_id, component, bool_or(event_type = 'purchase') AS covered FROM f WHERE component IS NOT NULL GROUP BY 1, 2),
h AS (SELECT *, bool_or(covered) OVER (PARTITION BY user_id) AS any_covered FROM g)
SELECT user_id, component FROM h WHERE NOT covered AND any_covered
""")
def coverage_gap(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    df = sequences.fill_forward(df, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type").isin("signup", "view"), F.col("event_type")), "component")
    df = df.where("component IS NOT NULL").groupBy("user_id", "component").agg(F.bool_or(F.col("event_type") == "purchase").alias("covered"))
    df = df.withColumn("any_covered", F.bool_or("covered").over(Window.partitionBy("user_id")))
    return df.where("NOT covered AND any_covered").select("user_id", "component")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)license|copyright')")
def absence_flag(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(~F.col("text").rlike("(?i)license|copyright")).select("doc_id")


@query(r"""
WITH b AS (SELECT item_id, regexp_replace(lower(text), '\s+', '', 'g') AS q FROM benchmark),
d AS (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS c FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON len(q) >= 4 AND contains(c, q)
""")
def quote_anchor(spark, sf_dir):
    quotes = read(spark, sf_dir, "benchmark").select("item_id", text.squeeze(F.col("text")).alias("q")).where(F.length("q") >= 4)
    docs = read(spark, sf_dir, "documents").select("doc_id", text.squeeze(F.col("text")).alias("c"))
    return retrieval.contained(docs, quotes)


@query("""
WITH o AS (
  SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_orderpriority,
    row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INTEGER), o_orderkey) AS r FROM orders
)
SELECT o_custkey, month, o_orderkey, o_orderpriority FROM o WHERE r = 1
""")
def priority_dedup(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_orderpriority")
    return ranking.priority_dedup(df, ["o_custkey", "month"], -F.substring("o_orderpriority", 1, 1).try_cast("int"), ["o_orderkey"])


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, CAST(substr(o_orderpriority, 1, 1) AS INTEGER), o_totalprice DESC, o_orderkey) AS rank FROM orders
""")
def tier_rank(spark, sf_dir):
    tier = text.ranked(F.col("o_orderstatus"), (("F", 0), ("O", 1)), 2)
    order = [tier, F.substring("o_orderpriority", 1, 1).try_cast("int"), F.desc("o_totalprice"), F.col("o_orderkey")]
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order))
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", rank.cast("long").alias("rank"))


@query("""
WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT doc_id, (3 + doc_id % 5) / 10.0::DOUBLE AS confidence FROM documents)
SELECT c.doc_id, CASE WHEN toxic IS NULL THEN confidence WHEN toxic = 1 THEN round(confidence * 0.4::DOUBLE, 2) ELSE least(round(confidence + 0.1::DOUBLE, 2), 0.9::DOUBLE) END AS confidence
FROM c LEFT JOIN l USING (doc_id)
""")
def challenge_rescore(spark, sf_dir):
    verdicts = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    df = read(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") % 5 + 3) / 10.0).alias("confidence")).join(verdicts, "doc_id", "left")
    return df.select("doc_id", ranking.rescore(F.col("confidence"), F.col("toxic") == 1, F.col("toxic").isNotNull()).alias("confidence"))


COSINE = "list_inner_product(a.x, b.x) / ((sqrt(list_inner_product(a.x, a.x)) + 1e-9) * (sqrt(list_inner_product(b.x, b.x)) + 1e-9))"
VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL)"


def nearest_to(vectors: DataFrame, vec_id: int, k: int) -> DataFrame:
    """The k rows nearest to one row's vector; none where that row is missing or has no vector."""
    own = vectors.where((F.col("vec_id") == vec_id) & F.col("embedding").isNotNull()).select("embedding").first()
    return retrieval.cosine_topk(vectors, own[0] if own else [], k if own else 0)


@query(f"WITH {VECTORS} SELECT a.vec_id, round({COSINE}, 6) AS score FROM v a, v b WHERE b.vec_id = 0 ORDER BY {COSINE} DESC, a.vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return nearest_to(vectors, 0, 10).withColumn("score", F.round("score", 6))


@query(f"""
WITH {VECTORS}, s AS (SELECT b.vec_id AS query_id, a.vec_id, {COSINE} AS score FROM v a, v b WHERE b.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3
""")
def cosine_topk_batch(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return batch_topk(vectors, vectors.where("vec_id % 20 = 0"))


def batch_topk(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    out = retrieval.cosine_topk_batch(vectors, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {VECTORS}, t AS (SELECT a.vec_id, {COSINE} AS score FROM v a, v b WHERE b.vec_id = 0 ORDER BY {COSINE} DESC, a.vec_id LIMIT 10)
SELECT vec_id, round(score, 6) AS score, lang, source, n_chars FROM t JOIN documents ON doc_id = vec_id
""")
def topk_join(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    hits = nearest_to(vectors, 0, 10)
    out = retrieval.fetch(hits, read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), F.col("doc_id") == F.col("vec_id"))
    return out.select("vec_id", F.round("score", 6).alias("score"), "lang", "source", "n_chars")


@query("""
SELECT doc_id, 1.0::DOUBLE AS score FROM documents
WHERE contains(lower(text), 'thing') OR contains(lower(source), 'thing') OR contains(lower(text), 'nation') OR contains(lower(source), 'nation')
ORDER BY doc_id LIMIT 25
""")
def keyword_search(spark, sf_dir):
    return retrieval.keyword_search(read(spark, sf_dir, "documents"), "the thing of nation", ["text", "source"], "doc_id", 25).select("doc_id", "score")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%customer%1%' AND c_name ILIKE '%1%' AND c_mktsegment ILIKE '%build%' ORDER BY c_custkey LIMIT 50")
def kb_filter(spark, sf_dir):
    return retrieval.like_filter(read(spark, sf_dir, "customer"), {"c_name": "1", "c_mktsegment": "build"}, "c_custkey").select("c_custkey", "c_name")


ALIAS = (("promo", "promotion"), ("standard", "regular"), ("economy", "regular"), ("small", "compact"))


@query("""
WITH a(alias, domain) AS (VALUES ('promo', 'promotion'), ('standard', 'regular'), ('economy', 'regular'), ('small', 'compact'))
SELECT p_partkey, coalesce(domain, '') AS domain FROM part LEFT JOIN a ON lower(split_part(p_type, ' ', 1)) = alias
""")
def alias_lookup(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", retrieval.canonical_domain(F.substring_index("p_type", " ", 1), ALIAS).alias("domain"))


def _heading_match(part):
    num = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"))
    page = F.floor(F.col("p_partkey") / 50)
    blocks = part.select(F.col("p_partkey").alias("block_idx"), F.concat(num, F.lit(" "), F.col("p_name")).alias("txt"), page.alias("page"))
    entries = part.select(num.alias("num"), page.alias("page"), F.col("p_partkey").alias("toc_ord"))
    from ..operators.sections import match_headings

    return match_headings(entries, blocks, []).select("num", "block_idx")


@query(r"""
WITH b AS (SELECT p_partkey AS block_idx, p_size || '.' || (p_partkey % 10) || ' ' || p_name AS txt, CAST(p_partkey // 50 AS BIGINT) AS page FROM part),
t AS (SELECT p_size || '.' || (p_partkey % 10) AS num, CAST(p_partkey // 50 AS BIGINT) AS page, p_partkey AS toc_ord FROM part),
c AS (SELECT num, toc_ord, page + d AS page, pref FROM t, (VALUES (0, 0), (1, 1), (-1, 2)) AS x(d, pref)),
m AS (
  SELECT c.num, b.block_idx, row_number() OVER (PARTITION BY c.num ORDER BY c.toc_ord, c.pref, b.block_idx) AS r
  FROM c JOIN b ON b.page = c.page AND starts_with(ltrim(b.txt), c.num) AND regexp_matches(b.txt, '^\s*' || regexp_escape(c.num) || '\.?(?:[^\d.]|$)')
)
SELECT num, block_idx FROM m WHERE r = 1
""")
def heading_match(spark, sf_dir):
    return _heading_match(read(spark, sf_dir, "part"))


@query("""
WITH f AS (
  SELECT event_id, user_id,
    last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS a,
    first_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b
  FROM events
)
SELECT event_id, user_id, coalesce(a, b) AS section FROM f
""")
def asof_section(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sequences.as_of(df, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "section").select("event_id", "user_id", "section")


@query("""
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n FROM i GROUP BY 1, 2
""")
def stitch_islands(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    part, order = ["user_id"], ["ts", "event_id"]
    df = sequences.islands(df, part, order, F.col("ts") - sequences.previous("ts", part, order) > F.expr("INTERVAL 6 HOUR"))
    return df.groupBy("user_id", "island").agg(F.count("*").alias("n"))


@query("""
WITH i AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS low, CAST(l_shipdate AS DATE) + 3 AS high FROM lineitem),
m AS (SELECT *, max(high) OVER (PARTITION BY l_suppkey ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i)
SELECT l_suppkey, CAST(seen AS VARCHAR) AS gap_start, CAST(low AS VARCHAR) AS gap_end FROM m WHERE low - seen > 10
""")
def interval_gaps(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("low"), F.date_add(F.to_date("l_shipdate"), 3).alias("high"))
    out = sequences.interval_gaps(df, ["l_suppkey"], "low", "high", F.expr("INTERVAL 10 DAY"))
    return out.select("l_suppkey", F.col("gap_start").cast("string").alias("gap_start"), F.col("gap_end").cast("string").alias("gap_end"))


@query("""
WITH g AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS group_no, o_totalprice FROM orders)
SELECT o_custkey, CAST(group_no AS BIGINT) AS group_no, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM g GROUP BY 1, 2
""")
def fixed_groups(spark, sf_dir):
    df = sequences.fixed_groups(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], 5)
    return df.groupBy("o_custkey", "group_no").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH u AS (SELECT doc_id, source, sum(length(text)) OVER w AS used, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, CAST(used AS BIGINT) AS used FROM u WHERE used <= 45000 OR n = 1
""")
def char_budget(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return sequences.char_budget(df, ["source"], ["doc_id"], F.col("n"), fixed.SECTION_BUDGET).select("doc_id", "source", "used")


@query("""
SELECT l_suppkey, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1,
  coalesce(min(l_discount), 1.0) AS confidence, coalesce(median(l_quantity), 1.0) AS unit FROM lineitem GROUP BY l_suppkey
""")
def bbox_union(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.min("l_extendedprice").alias("y0"), F.max("l_extendedprice").alias("y1"),
        F.coalesce(F.min("l_discount"), F.lit(1.0)).alias("confidence"), F.coalesce(F.median("l_quantity"), F.lit(1.0)).alias("unit"),
    )


RULES = [(r"license|copyright", "legal"), (r"[^ \n]@[^ \n]", "contact"), (r"[0-9]{4}", "numeric"), (r"[|]", "table")]


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, 'license|copyright') THEN 'legal' WHEN regexp_matches(text, '[^ \n]@[^ \n]') THEN 'contact'
  WHEN regexp_matches(text, '[0-9]{4}') THEN 'numeric' WHEN regexp_matches(text, '[|]') THEN 'table' ELSE 'unknown' END AS kind FROM documents
""")
def first_match_classify(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.first_match(F.col("text"), RULES, "unknown").alias("kind"))


@query(r"""
SELECT r_regionkey, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
""")
def render_markdown(spark, sf_dir):
    from ..operators.rendering import markdown_grid

    rows = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    cells = F.transform("rows", lambda r: F.array(r["n_name"], r["n_nationkey"].cast("string")))
    return read(spark, sf_dir, "region").join(rows, "r_regionkey").select("r_regionkey", markdown_grid(F.array(F.lit("nation"), F.lit("key")), cells).alias("markdown"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max(event_type, event_id) AS status, arg_max(CAST(value AS VARCHAR), event_id) FILTER (WHERE event_type = 'purchase') AS flaw_report,
  CAST(min(event_id) AS VARCHAR) AS created_at, CAST(max(event_id) FILTER (WHERE event_type = 'error') AS VARCHAR) AS completed_at FROM events GROUP BY user_id
""")
def latest_job(spark, sf_dir):
    no = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), no.alias("document_name"), F.col("event_type").alias("status"), F.col("event_id").cast("string").alias("at"),
        no.alias("intermediate_report"), F.when(F.col("event_type") == "purchase", F.col("value").cast("string")).alias("flaw_report"), no.alias("recommendations"),
    )
    return jobs.latest(rows).select("job_id", "status", "flaw_report", "created_at", "completed_at")


@query("SELECT user_id, event_type, count(*) AS n, bool_or(value > 100) AS done FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type")
def event_isolation(spark, sf_dir):
    df = read(spark, sf_dir, "events").where("event_type <> 'error'")
    return df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.bool_or(F.col("value") > 100).alias("done"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
SELECT 's' || (turn % 3) AS cmc_section, md5(coalesce(text, '')) AS said, verdict, count(*) AS n
FROM conversations, (VALUES ('pass'), ('minor_revision'), ('deeper_review')) AS v(verdict) GROUP BY 1, 2, 3
""")
def sft_examples(spark, sf_dir):
    section = F.concat(F.lit("s"), (F.col("turn") % 3).cast("string"))
    kb = read(spark, sf_dir, "conversations").select(section.alias("cmc_section"), F.lit("Method Validation").alias("deficiency_type"), F.col("text").alias("deficiency_text"), F.lit("Done. So.").alias("deficiency_response"))
    user = F.col("messages")[1]["content"]
    out = training.verdicts(kb, "Review.").select(F.regexp_extract(user, "Section: (s[0-9])", 1).alias("cmc_section"), F.regexp_extract(user, r"(?s)\nEvidence: (.*)\n\nProposed correction:", 1).alias("said"), "verdict")
    return out.groupBy("cmc_section", F.md5("said").alias("said"), "verdict").agg(F.count("*").alias("n"))


@query("SELECT true AS whole, true AS near_85, count(*) AS n FROM documents")
def train_split(spark, sf_dir):
    """The split is by a hash of Spark's own: that every record has a part, and the share of each, is what SQL can say."""
    out = training.split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "train").alias("t"), F.count_if(F.col("part") == "val").alias("v"))
    share = F.col("t") / F.greatest(F.col("n"), F.lit(1))
    return out.select((F.col("t") + F.col("v") == F.col("n")).alias("whole"), ((F.col("n") < 100) | share.between(0.75, 0.95)).alias("near_85"), "n")


@query(r"""
WITH p AS (SELECT doc_id, text, list_filter(list_transform(list_slice(string_split(replace(text, chr(10), ' '), '.'), 1, 3), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN 'Address the identified deficiency per FDA guidance.' WHEN len(p) > 0 THEN array_to_string(p, '. ') || '.' ELSE substr(text, 1, 200) END AS summary FROM p
""")
def summarize_first3(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("SELECT DISTINCT p_type FROM part WHERE p_type <> '' ORDER BY p_type")
def distinct_types(spark, sf_dir):
    return read(spark, sf_dir, "part").where("p_type <> ''").select("p_type").distinct().orderBy("p_type")
