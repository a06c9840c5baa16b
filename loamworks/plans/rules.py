"""Queries for the scalar rules, lookups, set operations and streams of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import domains, ranking, rendering, retrieval, sequences
from ..sources import readers
from ..streaming import events as log
from .registry import query, read


def _words(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_quantity * 1000 END AS value FROM lineitem")
def measured_numbers(spark, sf_dir):
    whole = F.format_number(F.col("l_quantity") * 1000, 0)  # with commas between thousands
    cell = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("< "), whole, F.lit(" %"))).when(F.col("l_returnflag") == "A", F.concat(whole, F.lit(" ND"))).otherwise(F.concat(whole, F.lit(".0")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.number(cell).alias("value"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS limit_at, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS result_at FROM events
""")
def header_columns(spark, sf_dir):
    names = [("Acceptance Limit", "Result"), ("Observed value", "Specification"), ("Compound", "Criteria"), ("Compound", "Area")]
    headers = F.element_at(F.array(*[F.array(*map(F.lit, n)) for n in names]), (F.col("event_id") % 4 + 1).cast("int"))
    at = lambda keys: text.column_like(F.col("h"), keys).cast("int")
    return read(spark, sf_dir, "events").select("event_id", headers.alias("h")).select("event_id", at(fixed.LIMIT_HEADERS).alias("limit_at"), at(fixed.RESULT_HEADERS).alias("result_at"))


@query(f"""
WITH c AS (SELECT p_partkey, {_words(fixed.CTD_SECTIONS)}[1 + CAST(least(p_partkey % 11, (p_partkey // 11) % 11) AS BIGINT)] AS code FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'unknown' ELSE code END AS code,
  CASE WHEN p_partkey % 13 = 0 THEN 'an unidentified CTD section' ELSE 'CTD ' || code || CASE WHEN code LIKE '3.2.S%' THEN ' (drug substance)' ELSE ' (drug product)' END END AS described FROM c
""")
def ctd_sections(spark, sf_dir):
    codes = F.array(*map(F.lit, fixed.CTD_SECTIONS))
    code = lambda n: F.replace(F.get(codes, F.pmod(n, F.lit(11)).cast("int")), F.lit("3.2."), F.lit("3.2. "))
    said = F.when(F.col("p_partkey") % 13 == 0, "no code").otherwise(F.concat(F.lit("see "), code(F.floor(F.col("p_partkey") / 11)), F.lit(" and "), code(F.col("p_partkey")), F.lit(".")))
    df = read(spark, sf_dir, "part").select("p_partkey", text.ctd_section(said).alias("code"))
    return df.withColumn("described", text.describe_section(F.col("code")))


@query("""
SELECT p_partkey, p_size || '.' || (p_partkey % 70) AS num, p_name AS title FROM part WHERE p_size <= 50 AND p_partkey % 70 <= 50
""")
def section_numbers(spark, sf_dir):
    said = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 70).cast("string"), F.lit(".  "), F.col("p_name"))
    num, title = text.section_number(said)
    return read(spark, sf_dir, "part").select("p_partkey", num.alias("num"), title.alias("title")).where(text.plausible_number(F.col("num")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS label FROM part")
def page_labels(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.col("p_name"), F.lit(" PAGE "), F.col("p_size").cast("string"), F.lit("  of 50"))).otherwise(F.lit("page of 50"))
    return read(spark, sf_dir, "part").select("p_partkey", text.page_label(said).alias("label"))


_HINTS = ", ".join(
    f"CASE WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)} THEN '{name}' END" for name, words in fixed.DOMAIN_HINTS
)


@query(f"""
WITH f AS (SELECT doc_id, list_filter([{_HINTS}], lambda x: x IS NOT NULL) AS d FROM documents)
SELECT doc_id, CASE WHEN len(d) > 0 THEN array_to_string(d, ',') ELSE '{",".join(fixed.DEFAULT_DOMAINS)}' END AS domains FROM f
""")
def fallback_domains(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(domains.fallback(F.col("text")), ",").alias("domains"))


@query("""
WITH a AS (SELECT conv_id, turn, list_filter(['stability', CASE WHEN turn % 2 = 0 THEN 'no such domain' END, 'impurities'], lambda x: x IS NOT NULL) AS d FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'specification,method-validation,impurities' ELSE 'stability,impurities' END AS domains FROM a
""")
def chosen_domains(spark, sf_dir):
    some = F.when(F.col("turn") % 2 == 0, '"no such domain", ').otherwise("")
    answer = F.when(F.col("turn") % 3 == 0, "none").otherwise(F.concat(F.lit('I choose [" stability", '), some, F.lit('"impurities", "stability"].')))
    known = [name for name, _ in fixed.DOMAIN_HINTS]
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(domains.chosen(answer, F.lit(""), known), ",").alias("domains"))


SCOPES = tuple(name for name, _ in fixed.DOMAIN_HINTS)
_TERMS = {d: [*d.split("-"), *(w for w in dict(fixed.DOMAIN_HINTS)[d] if w not in d.split("-"))] for d in SCOPES}


@query(f"""
WITH d(domain, terms) AS (VALUES {", ".join(f"('{d}', {_words(t)})" for d, t in _TERMS.items())}),
h AS (SELECT source, domain, doc_id, len(list_filter(terms, lambda t: contains(lower(text), t))) > 0 AS hit FROM documents, d WHERE source IS NOT NULL),
a AS (SELECT *, bool_or(hit) OVER (PARTITION BY source, domain) AS any_hit FROM h)
SELECT source, domain, doc_id FROM a WHERE hit OR NOT any_hit
""")
def domain_scope(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    names = F.explode(F.array(*map(F.lit, SCOPES))).alias("domain")
    sections = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("section_ord"), F.lit("").alias("heading"), "text")
    out = domains.scope(docs.select(F.col("source").alias("doc_id")).distinct().select("doc_id", names), sections)
    return out.select(F.col("doc_id").alias("source"), "domain", F.col("section_ord").alias("doc_id"))


@query("""
WITH s AS (SELECT c_custkey AS doc_id, i AS section_ord, ['f results', 'data of o', 'methods'][i] AS heading, ['Table 1 a', 'TABLE  2', 'Table 11'][i] AS title FROM customer, (VALUES (1), (2), (3)) AS n(i)),
f AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CAST(o_orderkey % 13 AS VARCHAR) AS n, lower(o_orderstatus) AS s FROM orders),
t AS (SELECT doc_id, section_ord, regexp_extract(lower(title), 'table\\s*(\\d+)', 1) AS n, heading FROM s),
h AS (
  SELECT f.doc_id, ord, section_ord, 0 AS way FROM f JOIN t ON f.doc_id = t.doc_id AND f.n = t.n
  UNION ALL SELECT f.doc_id, ord, section_ord, 1 FROM f JOIN t ON f.doc_id = t.doc_id AND contains(heading, s)
), m AS (SELECT doc_id, ord, section_ord, min(way) AS way FROM h GROUP BY 1, 2, 3)
SELECT * FROM m UNION ALL
SELECT f.doc_id, ord, section_ord, 2 FROM f JOIN s ON f.doc_id = s.doc_id WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.ord = f.ord)
""")
def challenge_context(spark, sf_dir):
    three = F.array(*[F.struct(F.lit(i).alias("section_ord"), F.lit(h).alias("heading"), F.lit(t).alias("title")) for i, h, t in ((1, "F results", "Table 1 a"), (2, "Data of O", "TABLE  2"), (3, "Methods", "Table 11"))])
    sections = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(three))
    number = (F.col("o_orderkey") % 13).cast("string")
    findings = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("see table "), number).alias("table_ref"), F.col("o_orderstatus").alias("section"))
    return domains.context(findings, sections, sections)


@query("""
SELECT p_brand, p_size, arg_min(p_retailprice, p_partkey) AS first_price, min(p_partkey) AS first_page, max(p_partkey) AS last_page, count(*) AS n FROM part GROUP BY p_brand, p_size
""")
def page_spans(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(
        F.min_by("p_retailprice", "p_partkey").alias("first_price"), F.min("p_partkey").alias("first_page"), F.max("p_partkey").alias("last_page"), F.count("*").alias("n"),
    )


@query("""
WITH g AS (SELECT l_suppkey, l_extendedprice AS x, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) <= 160 THEN 0 ELSE 1 END AS s, l_orderkey, l_linenumber FROM lineitem),
c AS (SELECT l_suppkey, x, sum(s) OVER (PARTITION BY l_suppkey ORDER BY x, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT l_suppkey, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(x) AS low, max(x) AS high FROM c GROUP BY 1, 2
""")
def gap_clusters(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"))
    part, order = ["l_suppkey"], ["x", "l_orderkey", "l_linenumber"]
    df = sequences.islands(df, part, order, F.col("x") - sequences.previous("x", part, order) > 160, "cluster")
    return df.groupBy("l_suppkey", "cluster").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("""
WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM f
""")
def ordered_distinct(spark, sf_dir):
    df = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return df.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("long").alias("place"))


@query("""
SELECT 'quantity' AS source, l_orderkey AS id, l_quantity AS value FROM lineitem WHERE l_quantity > 49
UNION ALL SELECT 'price', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT 'balance', c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0
""")
def union_findings(spark, sf_dir):
    of = lambda name, source, key, value, rule: read(spark, sf_dir, name).where(rule).select(F.lit(source).alias("source"), F.col(key).alias("id"), F.col(value).alias("value"))
    out = of("lineitem", "quantity", "l_orderkey", "l_quantity", "l_quantity > 49").unionByName(of("orders", "price", "o_orderkey", "o_totalprice", "o_totalprice > 300000"))
    return out.unionByName(of("customer", "balance", "c_custkey", "c_acctbal", "c_acctbal < 0"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def unreferenced(spark, sf_dir):
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey").join(returned, "p_partkey", "left_anti")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS anda_number, c_name AS product_name, c_mktsegment AS cmc_section, CAST(c_acctbal > 0 AS VARCHAR) AS deficiency_text, CAST(c_nationkey AS VARCHAR) AS batch_no FROM customer
""")
def kb_columns(spark, sf_dir):
    c = F.col
    named = [c("c_custkey").alias("ANDA #"), c("c_name").alias("Product Name"), c("c_mktsegment").alias("CMC Section"), (c("c_acctbal") > 0).alias("Deficiency"), c("c_nationkey").alias("Batch No")]
    return readers.kb(read(spark, sf_dir, "customer").select(*named))


@query("SELECT conv_id, turn, concat_ws(' | ', nullif(role, ''), CASE WHEN turn % 2 = 0 THEN 'even' END, nullif(text, '')) AS embedded FROM conversations")
def embedding_texts(spark, sf_dir):
    even = F.when(F.col("turn") % 2 == 0, "even").otherwise("")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", readers.embedding_text(F.col("role"), F.lit(""), even, F.col("text")).alias("embedded"))


@query(r"SELECT conv_id, turn, md5(regexp_replace(lower(coalesce(text, '')), '\s+', '', 'g')) AS squeezed FROM conversations")
def normalized_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.squeeze(F.col("text"))).alias("squeezed"))


@query("SELECT doc_id, CAST(table_no AS BIGINT) AS table_no FROM (SELECT doc_id, doc_id % 17 AS table_no FROM documents) WHERE table_no > 3")
def table_numbers(spark, sf_dir):
    said = F.concat(F.lit("as in TABLE  "), (F.col("doc_id") % 17).cast("string"), F.lit(" and Table 99"))
    return read(spark, sf_dir, "documents").select("doc_id", text.table_number(said).cast("long").alias("table_no")).where("table_no > 3")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, len(x) AS size, round(list_inner_product(x, x) / greatest(list_inner_product(x, x), 1e-300), 3) AS length FROM v
""")
def unit_vectors(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", retrieval.unit(F.col("embedding")).alias("v"))
    return df.select("vec_id", F.size("v").cast("long").alias("size"), F.round(retrieval.norm(F.col("v")), 3).alias("length"))


_EVENTS = """
e AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'parse' ELSE 'detection' END AS layer, CASE event_type WHEN 'signup' THEN 'layer_complete' ELSE event_type END AS event_type FROM events)
"""


def _log(spark, sf_dir):
    layer = F.when(F.col("event_id") % 3 == 0, "parse").otherwise("detection")
    kind = F.when(F.col("event_type") == "signup", "layer_complete").otherwise(F.col("event_type"))
    raw = read(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("job_id"), layer.alias("layer"), kind.alias("event_type"))).alias("value"))
    return log.decode(raw)


@query(f"WITH {_EVENTS} SELECT CAST(user_id AS VARCHAR) AS job_id, layer, count(*) FILTER (WHERE event_type <> 'layer_complete') AS events, bool_or(event_type = 'layer_complete') AS done FROM e GROUP BY 1, 2")
def layer_progress(spark, sf_dir):
    return log.progress(_log(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT CAST(user_id AS VARCHAR) AS job_id, layer, event_type, count(*) AS n FROM e WHERE event_type <> 'layer_complete' GROUP BY 1, 2, 3")
def shown_activity(spark, sf_dir):
    return log.activity(_log(spark, sf_dir)).groupBy("job_id", "layer", "event_type").agg(F.count("*").alias("n"))


def _stream(spark, sf_dir):
    """The event log as a stream: of the folder's files only that of the events is read."""
    schema = read(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return job_events(rows)


def job_events(rows: DataFrame) -> DataFrame:
    """The events table, or a stream of it, as events of jobs."""
    layer = F.when(F.col("event_id") % 3 == 0, "parse").otherwise("detection")
    done = F.when(F.col("event_type") == "signup", "layer_complete").when((F.col("event_type") == "error") & (F.col("value") > 50), "pipeline_complete").otherwise(F.col("event_type"))
    return rows.select(F.col("user_id").cast("string").alias("job_id"), layer.alias("layer"), done.alias("event_type"), F.col("event_id").cast("string").alias("message"), F.timestamp_seconds("event_id").alias("at"))


_STREAM = """
e AS (
  SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'parse' ELSE 'detection' END AS layer,
    CASE WHEN event_type = 'signup' THEN 'layer_complete' WHEN event_type = 'error' AND value > 50 THEN 'pipeline_complete' ELSE event_type END AS event_type FROM events
)
"""


@query(f"WITH {_STREAM} SELECT CAST(user_id AS VARCHAR) AS job_id, layer, count(*) FILTER (WHERE event_type <> 'layer_complete') AS events, bool_or(event_type = 'layer_complete') AS done FROM e GROUP BY 1, 2")
def streamed_progress(spark, sf_dir):
    out = log.drain(log.progress(_stream(spark, sf_dir)), "update")
    return out.groupBy("job_id", "layer").agg(F.max_by("events", "batch").alias("events"), F.max_by("done", "batch").alias("done"))


@query(f"""
WITH {_STREAM}, c AS (SELECT user_id, min(event_id) AS last FROM e WHERE event_type = 'pipeline_complete' GROUP BY user_id)
SELECT CAST(e.user_id AS VARCHAR) AS job_id, layer, event_type, CAST(event_id AS VARCHAR) AS message FROM e LEFT JOIN c ON c.user_id = e.user_id WHERE last IS NULL OR event_id <= last
""")
def streamed_until_complete(spark, sf_dir):
    return log.drain(log.until_complete(_stream(spark, sf_dir))).drop("batch")


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{"turn": ' || turn || '}' WHEN 1 THEN '[' || turn || ']' ELSE 'plain ' || turn END AS blob FROM conversations
""")
def json_blobs(spark, sf_dir):
    n = F.col("turn").cast("string")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('Here:\n```json\n{"turn": '), n, F.lit("}\n```\nDone."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("so ["), n, F.lit("] then"))).otherwise(F.concat(F.lit(" plain "), n, F.lit("\n")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.json_blob(said).alias("blob"))


@query(r"SELECT conv_id, turn, trim(replace(replace(role || chr(10) || 'a|b', chr(10), ' '), '|', '\|')) AS cell FROM conversations")
def markdown_cells(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.markdown_cell(F.concat("role", F.lit("\na|b "))).alias("cell"))


@query("""
SELECT n_regionkey, 'Section headings:' || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS digest FROM nation GROUP BY n_regionkey
""")
def heading_digest(spark, sf_dir):
    df = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("h"))
    return df.select("n_regionkey", domains.digest(F.transform("h", lambda h: h["n_name"])).alias("digest"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT c_nationkey, string_agg('- [' || CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE c_name END || '] ' || c_mktsegment, chr(10) ORDER BY r) AS lines FROM r WHERE r <= 3 GROUP BY c_nationkey
""")
def precedent_lines(spark, sf_dir):
    product = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name"))
    # Ranked before they are gathered: three rows of a group leave its window, however large it is.
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    df = read(spark, sf_dir, "customer").select("c_nationkey", rank.alias("r"), product.alias("product_name"), F.col("c_mktsegment").alias("deficiency_text")).where("r <= 3")
    df = df.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("r", "product_name", "deficiency_text"))).alias("p"))
    return df.select("c_nationkey", domains.precedent_lines(F.col("p")).alias("lines"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE '**' || p_name || '** (p.' || p_size || ')' END AS caption FROM part
""")
def table_captions(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", rendering.caption(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")), F.col("p_size")).alias("caption"))


_SQUEEZED = r"regexp_replace(lower(coalesce({}, '')), '\s+', '', 'g')"


def _verified(docs, quotes, on):
    """Three findings of each document, with evidence dealt to them by `on`, verified and ranked; and the evidence."""
    corpus = docs.select("doc_id", text.squeeze(F.col("text")).alias("corpus"))
    three = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord"))
    firm = F.col("ord") == 2
    findings = three.join(quotes, on).select(
        "doc_id", "ord", F.concat(F.lit("Finding "), F.col("ord").cast("string")).alias("title"), F.lit("").alias("section"), F.lit("").alias("table_ref"), "evidence",
        F.when(firm, "checklist").otherwise("model_judgment").alias("evidence_class"), F.when(firm, "corroborated").otherwise("advisory").alias("tier"),
        F.lit("medium").alias("severity"), F.lit(0.9).alias("confidence"), F.lit(False).alias("novel"), F.array().cast("array<string>").alias("precedents"),
    )
    return ranking.verify_and_tier(findings, corpus), findings.select("doc_id", "ord", "evidence")



def _order(spark, sf_dir):
    """The whole benchmark with each row's place in it, from 0, and its number of rows."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("evidence")).orderBy("item_id", "evidence")
    placed = rows.rdd.zipWithIndex().map(lambda r: (r[1], r[0]["evidence"]))  # parts are counted first, so no task takes all
    return spark.createDataFrame(placed, "place long, evidence string"), rows.count()


VERIFIED_SQL = rf"""
WITH b AS (SELECT row_number() OVER (ORDER BY item_id NULLS FIRST, text NULLS FIRST) - 1 AS place, text AS evidence FROM benchmark),
c AS (SELECT doc_id, {_SQUEEZED.format("text")} AS corpus FROM documents),
f AS (SELECT doc_id, ord, evidence FROM (SELECT doc_id, i AS ord FROM documents, (VALUES (0), (1), (2)) AS n(i)) JOIN b ON place = (doc_id * 3 + ord) % nullif((SELECT count(*) FROM benchmark), 0)),
t AS (
  SELECT f.doc_id, ord, CASE WHEN ord = 2 THEN 'checklist' WHEN len({_SQUEEZED.format("evidence")}) >= 4 AND contains(corpus, {_SQUEEZED.format("evidence")}) THEN 'quote_anchored' ELSE 'model_judgment' END AS evidence_class
  FROM f JOIN c USING (doc_id)
), s AS (
  SELECT doc_id, ord, evidence_class, CASE WHEN ord = 2 THEN 'corroborated' ELSE 'advisory' END AS tier, ord <> 2 AS novel,
    CASE evidence_class WHEN 'checklist' THEN 0.9 WHEN 'quote_anchored' THEN 0.4 ELSE 0.3 END::DOUBLE AS confidence FROM t
)
"""


def verified(spark, sf_dir):
    """Three findings of each document, verified and ranked, and the evidence dealt to them from the whole benchmark."""
    docs = read(spark, sf_dir, "documents")
    quotes, n = _order(spark, sf_dir)
    return _verified(docs, quotes, F.col("place") == (F.col("doc_id") * 3 + F.col("ord")) % F.lit(n or None).cast("long"))


@query(VERIFIED_SQL + "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier <> 'corroborated', confidence DESC, ord) AS rank FROM s")
def verified_findings(spark, sf_dir):
    found, _ = verified(spark, sf_dir)
    return found.select("doc_id", "ord", "evidence_class", "tier", "novel", "confidence", F.col("rank").cast("long").alias("rank"))
