"""Numbered sections: heading detection, cross-page tables, and what belongs to which section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import plausible_number, section_number, strip
from . import sequences


def kept_pages(pages: DataFrame) -> DataFrame:
    """All pages but the cover; short documents (two pages at most) keep it."""
    return pages.where((F.col("page_count") <= 2) | (F.col("page_number") > 1))


def body_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of (doc_id, page, reading_order, role, text, n_lines, y0) without running heads, numbered in order from 0."""
    df = blocks.where(~F.coalesce("role", F.lit("")).isin("page_header", "page_footer"))
    return df.withColumn("block_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "reading_order")) - 1)


def match_headings(entries: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """For each number in a table of contents (num, page, toc_ord) the block (page, block_idx, txt) that opens its section.

    A block may stand on the stated page, the next, or the one before, in that order of
    preference; of several entries of a number the first that finds a block counts. The candidate
    pages make it an equi-join on page.
    """
    near = F.explode(F.array(*[F.struct((F.col("page") + d).cast("long").alias("page"), F.lit(p).alias("pref")) for d, p in ((0, 0), (1, 1), (-1, 2))])).alias("c")
    wide = entries.select(*by, "num", "toc_ord", *[c for c in entries.columns if c == "title"], near).select(*by, "num", "toc_ord", *[c for c in entries.columns if c == "title"], "c.page", "c.pref")
    at = blocks.withColumn("page", F.col("page").cast("long"))
    rest = F.expr("substring(ltrim(txt), length(num) + 1)")
    hit = F.startswith(F.ltrim("txt"), F.col("num")) & ~rest.rlike(r"^\.?[\d.]")
    both = wide.join(at, [*by, "page"]).where(hit)
    first = F.row_number().over(Window.partitionBy(*by, "num").orderBy("toc_ord", "pref", "block_idx"))
    return both.withColumn("_r", first).where("_r = 1").drop("_r", "pref")


def geometry_headings(body: DataFrame) -> DataFrame:
    """Headings by numbering and shape: short, at most two lines, a plausible number, and a title that opens with a capital."""
    num, title = section_number(F.col("text"))
    letter = F.regexp_extract("title", r"(\p{L})", 1)
    df = body.where((F.length("text") <= 120) & (F.coalesce("n_lines", F.lit(0)) <= 2)).withColumns({"num": num, "title": title})
    df = df.where(plausible_number(F.col("num")) & ~F.col("title").rlike(r"^[\d.\-+\s×xX%μµ]") & letter.rlike(r"\p{Lu}"))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "num").orderBy("block_idx"))).where("_r = 1").select("doc_id", "block_idx", "num", "title")


def headings(toc: DataFrame, body: DataFrame) -> DataFrame:
    """Headings by the table of contents where two entries at least are found in the document, else by shape."""
    num, title = section_number(F.col("title"))
    entries = toc.select("doc_id", num.alias("num"), title.alias("title"), "page", "toc_ord").where("num <> ''")
    by_toc = match_headings(entries, body.select("doc_id", "page", "block_idx", F.col("text").alias("txt")), ["doc_id"]).select("doc_id", "block_idx", "num", "title")
    enough = by_toc.groupBy("doc_id").count().where("count >= 2").select("doc_id")
    return by_toc.join(enough, "doc_id", "left_semi").unionByName(geometry_headings(body).join(enough, "doc_id", "left_anti"))


def stitch_tables(tables: DataFrame) -> DataFrame:
    """Merges grids that run on over pages: (doc_id, page, page_height, title, kind, headers, rows, n_cols, bbox).

    A fragment goes on from the one before it if it is an untitled grid on the next page with as
    many columns and the same edges, from the bottom of one page to the top of the next. A header
    that repeats the first fragment's is dropped, any other first line is data.
    """
    part, order = ["doc_id"], ["page", F.coalesce("bbox.y0", F.lit(0.0)), "table_ord"]
    df = tables.withColumn("table_ord", F.coalesce("table_ord", F.lit(0))) if "table_ord" in tables.columns else tables.withColumn("table_ord", F.lit(0))
    was = lambda c: sequences.previous(c, part, order)
    grid = (F.col("kind") == "grid") & (was("kind") == "grid")
    shape = (F.coalesce(F.col("title"), F.lit("")) == "") & (F.col("n_cols") == was("n_cols")) & (F.col("n_cols") != 0)
    edges = (F.abs(F.col("bbox.x0") - was("bbox.x0")) <= fixed.STITCH_EDGE) & (F.abs(F.col("bbox.x1") - was("bbox.x1")) <= fixed.STITCH_EDGE)
    low = (F.coalesce(was("page_height"), F.lit(0.0)) == 0) | (was("bbox.y1") >= was("page_height") * fixed.STITCH_BOTTOM)
    high = (F.coalesce("page_height", F.lit(0.0)) == 0) | (F.col("bbox.y0") <= F.col("page_height") * fixed.STITCH_TOP)
    goes_on = F.coalesce(grid & (F.col("page") == was("page") + 1) & shape & edges & low & high, F.lit(False))
    df = sequences.islands(df, part, order, ~goes_on, "chain")
    row = F.struct("page", F.coalesce("bbox.y0", F.lit(0.0)).alias("y"), "table_ord", "title", "kind", "headers", "rows", "n_cols", "bbox")
    df = df.groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(row)).alias("f"))
    head = F.get("f", F.lit(0))
    low_ = lambda h: F.transform(F.coalesce(h, F.array()), lambda c: F.lower(strip(c)))
    more = lambda t: F.when((F.size(t["headers"]) == 0) | (low_(t["headers"]) == low_(head["headers"])), t["rows"]).otherwise(F.concat(F.array(t["headers"]), t["rows"]))
    rows = F.concat(head["rows"], F.flatten(F.transform(F.slice("f", 2, 1 << 20), more)))
    return df.select(
        "doc_id", head["page"].alias("page"), head["y"].alias("y"), head["title"].alias("title"), head["kind"].alias("kind"), head["headers"].alias("headers"), rows.alias("rows"),
        head["n_cols"].alias("n_cols"), F.transform("f", lambda t: t["page"]).alias("source_pages"), (F.size("f") > 1).alias("continues_to"),
    ).withColumn("n_rows", F.size("rows") + 1)


def split(body: DataFrame, heads: DataFrame, filename: Column | None = None) -> DataFrame:
    """Sections (doc_id, section_ord, heading, text, page_start, page_end, y_start) of the body blocks.

    A section runs from its heading to the next. What comes before the first heading is a section
    of its own if it has more than 200 characters, else it goes. A document without headings is
    one section under its file's name.
    """
    df = body.join(heads.select("doc_id", "block_idx", F.concat_ws(" ", "num", "title").alias("heading"), F.col("block_idx").alias("start")), ["doc_id", "block_idx"], "left")
    df = sequences.fill_forward(df, ["doc_id"], ["block_idx"], F.col("start"), "start_at")
    df = df.withColumn("any", F.count("start").over(Window.partitionBy("doc_id")))
    key = F.coalesce("start_at", F.lit(-1))
    line = F.struct("block_idx", F.coalesce("text", F.lit("")).alias("text"), "page", F.coalesce("y0", F.lit(0.0)).alias("y"))
    out = df.groupBy("doc_id", key.alias("start_at"), "any").agg(F.max("heading").alias("heading"), F.array_sort(F.collect_list(line)).alias("b"), F.sum(F.length("text")).alias("n"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    out = out.where((F.col("start_at") >= 0) | (F.col("any") == 0) | (F.col("n") > 200))
    name = F.when(F.col("start_at") >= 0, F.col("heading")).when(F.col("any") == 0, F.lit("") if filename is None else filename).otherwise("Main Content")
    body_text = F.array_join(F.filter(F.transform("b", lambda x: x["text"]), lambda t: t != ""), "\n")
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_at"))
    return out.select("doc_id", ord_.alias("section_ord"), name.alias("heading"), body_text.alias("text"), "page_start", "page_end", F.get("b", F.lit(0))["y"].alias("y_start"))


def owner(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section_ord to items (doc_id, page, y): the last section that starts at or before them, else the first."""
    starts = sections.select("doc_id", F.col("page_start").alias("page"), F.col("y_start").alias("y"), "section_ord", F.lit(0).alias("_item"))
    both = items.withColumn("_item", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    out = sequences.as_of(both, ["doc_id"], ["page", "y", "_item", F.coalesce("section_ord", F.lit(0))] if "section_ord" in both.columns else ["page", "y", "_item"], F.col("_item") == 0, F.col("section_ord"), "_own")
    return out.where("_item = 1").drop("section_ord", "_item").withColumnRenamed("_own", "section_ord")


def group_sections(sections: DataFrame, size: int = 5) -> DataFrame:
    out = sequences.fixed_groups(sections, ["doc_id"], ["section_ord"], size, "_g")
    return out.withColumn("group_id", F.concat(F.lit("group_"), F.col("_g").cast("string"))).drop("_g")
