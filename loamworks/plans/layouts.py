"""Queries for the geometry of pages: boxes, running heads, captions and tables that run on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, sections
from .registry import query, read


def _box(x0, y0, x1, y1):
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


@query("""
SELECT p_partkey, CASE WHEN p_size * 15.0 + 12 <= 792 * 0.12 THEN 'page_header' WHEN p_size * 15.0 >= 792 * 0.92 THEN 'page_footer' ELSE 'paragraph' END AS role FROM part
""")
def running_heads(spark, sf_dir):
    y = F.col("p_size") * 15.0
    return read(spark, sf_dir, "part").select("p_partkey", layout.role(F.col("p_name"), _box(F.lit(72.0), y, F.lit(540.0), y + 12), F.lit(792.0)).alias("role"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN 792.0 - 40 WHEN 2 THEN 612.0 - (p_size + 30) ELSE 20.0 END::DOUBLE AS x0,
  CASE p_partkey % 4 WHEN 0 THEN 20.0 WHEN 1 THEN p_size * 1.0 WHEN 2 THEN 792.0 - 40 ELSE 612.0 - (p_size + 30) END::DOUBLE AS y0 FROM part
""")
def rotated_boxes(spark, sf_dir):
    x = F.col("p_size").cast("double")
    turned = layout.rotated(_box(x, F.lit(20.0), x + 30, F.lit(40.0)), ((F.col("p_partkey") % 4) * 90).cast("int"), F.lit(612.0), F.lit(792.0))
    return read(spark, sf_dir, "part").select("p_partkey", turned.alias("b")).select("p_partkey", F.col("b.x0").alias("x0"), F.col("b.y0").alias("y0"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity * 10 AS x, l_discount * 5000 AS y FROM lineitem),
t AS (SELECT s_suppkey, 100.0 AS x0, 50.0 AS y0, 300.0 + s_suppkey % 7 * 10 AS x1, 250.0 AS y1 FROM supplier)
SELECT l_orderkey, l_linenumber FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE s_suppkey = l_suppkey AND x + 5 BETWEEN x0 AND x1 AND y + 6 BETWEEN y0 AND y1)
""")
def lines_outside_tables(spark, sf_dir):
    x, y = F.col("l_quantity") * 10, F.col("l_discount") * 5000
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.lit(1).alias("page"), "l_orderkey", "l_linenumber", x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 12).alias("y1"))
    right = F.lit(300.0) + F.col("s_suppkey") % 7 * 10
    tables = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("page"), _box(F.lit(100.0), F.lit(50.0), right, F.lit(250.0)).alias("bbox"))
    return layout.outside_tables(rows, tables).select("l_orderkey", "l_linenumber")


@query("""
WITH f AS (SELECT p_partkey, p_size, p_partkey % 100 AS page, CAST(p_size * 10 AS DOUBLE) AS y0 FROM part),
c AS (SELECT s_suppkey, s_name, s_suppkey % 100 AS page, CAST(s_suppkey % 9 * 60 AS DOUBLE) AS c0 FROM supplier),
n AS (SELECT p_partkey, s_name, row_number() OVER (PARTITION BY p_partkey ORDER BY greatest(0.0, c0 - (y0 + 50), y0 - (c0 + 12)), s_suppkey) AS r FROM f JOIN c USING (page))
SELECT p_partkey, coalesce(s_name, '') AS caption FROM f LEFT JOIN (SELECT * FROM n WHERE r = 1) USING (p_partkey)
""")
def nearest_captions(spark, sf_dir):
    y, c = (F.col("p_size") * 10).cast("double"), (F.col("s_suppkey") % 9 * 60).cast("double")
    figures = read(spark, sf_dir, "part").select(F.lit(0).alias("doc_id"), (F.col("p_partkey") % 100).alias("page"), F.col("p_partkey").alias("figure_ord"), y.alias("y0"), (y + 50).alias("y1"))
    captions = read(spark, sf_dir, "supplier").select(F.lit(0).alias("doc_id"), (F.col("s_suppkey") % 100).alias("page"), F.col("s_suppkey").alias("caption_ord"), F.col("s_name").alias("text"), c.alias("c0"), (c + 12).alias("c1"))
    return layout.captioned(figures, captions).select(F.col("figure_ord").alias("p_partkey"), "caption")


@query("""
WITH t AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey, o_orderstatus FROM orders),
s AS (SELECT *, CASE WHEN o_orderstatus <> 'F' AND lag(page) OVER w = page - 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY page)),
c AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY page) AS chain FROM s)
SELECT o_custkey, CAST(min(page) AS BIGINT) AS page, count(*) AS n_pages, CAST(count(*) + 1 AS BIGINT) AS n_rows, count(*) > 1 AS continues_to FROM c GROUP BY o_custkey, chain
""")
def stitched_tables(spark, sf_dir):
    # An order is a page with one grid; those of status F have a title, so they start a table of their own.
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    tables = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), page.alias("page"), F.lit(792.0).alias("page_height"), F.when(F.col("o_orderstatus") == "F", "Table").otherwise("").alias("title"),
        F.lit("grid").alias("kind"), F.array(F.lit("Order "), F.lit("Status")).alias("headers"), F.array(F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))).alias("rows"),
        F.lit(2).alias("n_cols"), _box(F.lit(72.0), F.lit(80.0), F.lit(540.0), F.lit(740.0)).alias("bbox"),
    )
    out = sections.stitch_tables(tables)
    return out.select(F.col("doc_id").alias("o_custkey"), F.col("page").cast("long").alias("page"), F.size("source_pages").cast("long").alias("n_pages"), F.col("n_rows").cast("long").alias("n_rows"), "continues_to")


@query("""
WITH t AS (SELECT s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r, s_nationkey FROM supplier),
i AS (SELECT e.event_id, e.user_id % 25 AS s_nationkey, e.value AS y FROM events e WHERE e.value IS NOT NULL),
o AS (SELECT event_id, i.s_nationkey, max(r) FILTER (WHERE s_acctbal <= y) AS own, min(r) AS first FROM i JOIN t USING (s_nationkey) GROUP BY 1, 2)
SELECT i.event_id, CAST(coalesce(own, first) AS BIGINT) AS section_ord FROM i LEFT JOIN o USING (event_id)
""")
def owning_sections(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey"))
    starts = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("doc_id"), F.lit(1).alias("page_start"), F.col("s_acctbal").alias("y_start"), rank.alias("section_ord"))
    items = read(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", (F.col("user_id") % 25).alias("doc_id"), F.lit(1).alias("page"), F.col("value").alias("y"))
    return sections.owner(items, starts).select("event_id", F.col("section_ord").cast("long").alias("section_ord"))
