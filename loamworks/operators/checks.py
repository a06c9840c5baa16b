"""Deterministic checks over parsed documents; each gives findings."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources.readers import FINDING, blocks, explode_pages, grid_rows, tables
from . import sequences

RUNNING = ("page_header", "page_footer")


def _finding(df: DataFrame, **said) -> DataFrame:
    """Findings with defaults for what is not said; `ord` still has to be given."""
    fields = [f.strip().rsplit(" ", 1) if "<" not in f else f.strip().split(" ", 1) for f in _split(FINDING)]
    empty = {"string": F.lit(""), "boolean": F.lit(False), "int": F.lit(0), "long": F.lit(0)}
    out = []
    for name, kind in fields:
        value = F.col("doc_id") if name == "doc_id" else said.get(name)
        value = F.lit(value) if value is not None and not isinstance(value, Column) else value
        out.append((empty[kind] if value is None and kind in empty else F.array() if value is None else value).cast(kind).alias(name))
    return df.select(*out)


def _split(schema: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[at:i])
            at = i + 1
    return [*parts, schema[at:]]


def _place(*cols: str) -> Column:
    return reduce(lambda a, c: a * 10_000 + F.coalesce(F.col(c), F.lit(0)).cast("long"), cols, F.lit(0).cast("long"))


def page_texts(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, text: prose without running heads, then pairs and rows, in order."""
    prose = F.filter(F.coalesce("page.blocks", F.array()), lambda b: ~F.coalesce(b["role"], F.lit("")).isin(*RUNNING))
    rows = lambda t: F.transform(F.coalesce(t["rows"], F.array()), lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " "))
    pairs = lambda t: F.transform(F.coalesce(t["pairs"], F.array()), lambda p: F.concat_ws(" ", F.coalesce(p["label"], F.lit("")), F.coalesce(p["value"], F.lit(""))))
    cells = F.flatten(F.transform(F.coalesce("page.tables", F.array()), lambda t: F.when(t["kind"] == "key_value", pairs(t)).otherwise(rows(t))))
    titles = F.flatten(F.transform(F.coalesce("page.tables", F.array()), lambda t: F.concat(F.when(F.coalesce(t["title"], F.lit("")) != "", F.array(t["title"])).otherwise(F.array()), F.when(t["kind"] == "key_value", pairs(t)).otherwise(rows(t)))))
    said = F.transform(prose, lambda b: F.coalesce(b["text"], F.lit("")))
    return explode_pages(docs).select(
        "doc_id", "page_ord", F.coalesce("page.page_number", F.lit(0)).alias("page_number"),
        F.array_join(F.concat(said, cells), " ").alias("text"), F.lower(F.array_join(F.concat(said, titles), "\n")).alias("lines"),
    )


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, said: the reading-order text of each document, lower case; documents without pages have none."""
    rows = page_texts(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_ord", "lines"))).alias("p"))
    return docs.select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.transform("p", lambda x: x["lines"]), "\n"), F.lit("")).alias("said"))


def corpus(docs: DataFrame) -> DataFrame:
    """doc_id, corpus: all cells, values and blocks of a document without white space, for verbatim anchoring."""
    cells = F.flatten(F.transform(F.coalesce("page.tables", F.array()), lambda t: F.when(t["kind"] == "key_value", F.transform(F.coalesce(t["pairs"], F.array()), lambda p: F.coalesce(p["value"], F.lit("")))).otherwise(F.flatten(F.coalesce(t["rows"], F.array())))))
    said = F.transform(F.coalesce("page.blocks", F.array()), lambda b: F.coalesce(b["text"], F.lit("")))
    pages = explode_pages(docs).select("doc_id", "page_ord", text.squeeze(F.array_join(F.concat(cells, said), " ")).alias("t"))
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_ord", "t"))).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("corpus"))


def result_vs_limit(docs: DataFrame) -> DataFrame:
    """Rows of a grid whose result breaks the limit in the same row."""
    df = grid_rows(docs).withColumns({"li": text.column_like(F.col("headers"), fixed.LIMIT_HEADERS), "ri": text.column_like(F.col("headers"), fixed.RESULT_HEADERS)})
    df = df.where("li IS NOT NULL AND ri IS NOT NULL AND size(row) > greatest(li, ri)")
    df = df.withColumns({"lim": text.limit(F.get("row", F.col("li"))), "val": text.number(F.get("row", F.col("ri")))}).where(~text.satisfies(F.col("val"), F.col("lim")))
    name, r, l = F.coalesce(F.get("row", F.lit(0)), F.lit("")), F.get("row", F.col("ri")), F.get("row", F.col("li"))  # noqa: E741
    return _finding(
        df, ord=_place("page_ord", "table_ord", "row_ord"), title=F.concat(name, F.lit(": result "), r, F.lit(" is outside its limit "), l), detail=F.concat(F.lit("The reported result breaks the acceptance criterion of its own row: "), F.concat_ws(" | ", "row")),
        category="specification_mismatch", severity="high", tier="verified", evidence_class="code_verified", confidence=0.95, evidence=F.concat_ws(" | ", "row"), page=F.col("page_number"), table_ref=F.substring(F.coalesce("title", F.lit("")), 1, 80), source="oracle:result_vs_limit",
    )


def value_vs_inline_limit(docs: DataFrame) -> DataFrame:
    """Cells that state a value and, in brackets, a limit that it breaks."""
    df = grid_rows(docs).select("doc_id", "page_ord", "table_ord", "row_ord", "page_number", "title", F.get("row", F.lit(0)).alias("name"), F.posexplode("row").alias("col_ord", "cell"))
    value, lim = text.inline(F.col("cell"))
    df = df.withColumns({"val": value, "lim": lim}).where(~text.satisfies(F.col("val"), F.col("lim")))
    return _finding(
        df, ord=_place("page_ord", "table_ord", "row_ord", "col_ord"), title=F.concat(F.coalesce("name", F.lit("")), F.lit(": value outside the limit stated beside it")), detail=F.concat(F.lit("The cell states "), F.col("cell")),
        category="specification_mismatch", severity="high", tier="verified", evidence_class="code_verified", confidence=0.95, evidence=F.col("cell"), page=F.col("page_number"), table_ref=F.substring(F.coalesce("title", F.lit("")), 1, 80), source="oracle:value_vs_inline_limit",
    )


def conflicting_thresholds(docs: DataFrame) -> DataFrame:
    """A threshold that a document states with different values in one unit."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(fixed.AET), F.lit(1)).alias("v"), F.regexp_extract_all("text", F.lit(fixed.AET), F.lit(2)).alias("u"))
    df = page_texts(docs).select("doc_id", "page_ord", "page_number", F.explode(both).alias("x"))
    df = df.select("doc_id", "page_ord", "page_number", F.round(F.col("x")["v"].try_cast("double"), 3).alias("v"), F.concat(F.lit("µg/"), F.lower(F.col("x")["u"])).alias("unit"))
    df = df.groupBy("doc_id", "unit", "v").agg(F.min_by("page_number", "page_ord").alias("page")).groupBy("doc_id", "unit").agg(F.map_from_entries(F.collect_list(F.struct("v", "page"))).alias("pages"))
    df = df.withColumn("k", text.collapse_near(F.map_keys("pages"))).where(F.size("k") >= 2)
    listing = F.array_join(F.transform("k", lambda v: F.concat(v.cast("string"), F.lit(" "), F.col("unit"), F.lit(" (p."), F.element_at("pages", v).cast("string"), F.lit(")"))), ", ")
    return _finding(
        df, ord=F.when(F.col("unit") == "µg/g", 0).otherwise(1), title="AET stated with conflicting values across the document", detail=F.concat(F.lit("One threshold should have one value, but it is stated as "), listing),
        category="specification_mismatch", severity="high", tier="verified", evidence_class="code_verified", confidence=0.9, evidence=listing, source="oracle:cross_reference_aet",
    )


def missing_elements(docs: DataFrame, section: DataFrame | None = None) -> DataFrame:
    """Elements of method validation that a validation document never mentions."""
    df = _whole(docs).join(section if section is not None else sections_of(docs), "doc_id").where(F.col("section_code").isin(*fixed.VALIDATION_SECTIONS))
    want = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.array(*map(F.lit, ks)).alias("keys")) for i, (n, ks) in enumerate(fixed.VALIDATION_ELEMENTS)])
    df = df.select("doc_id", F.explode(F.filter(want, lambda e: ~F.exists(e["keys"], lambda k: F.contains(F.col("said"), k)))).alias("e"))
    return _finding(
        df, ord=F.col("e.i"), title=F.concat(F.lit("Method validation does not address "), F.col("e.name")), detail=F.concat(F.lit("Nothing in the document mentions "), F.col("e.name")),
        category="method_validation_gap", severity="medium", tier="corroborated", evidence_class="checklist", confidence=0.6, source="checklist:validation_elements",
    )


def sections_of(docs: DataFrame) -> DataFrame:
    """doc_id, section_code by the first three pages' text, or the file's name if they have none."""
    lead = blocks(docs).where("page_ord < 3").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_ord", "block_ord", "text"))).alias("b"))
    df = docs.select("doc_id", "filename").join(lead, "doc_id", "left").withColumn("t", F.array_join(F.transform("b", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"))
    return df.select("doc_id", text.ctd_section(F.coalesce(F.nullif(F.trim("t"), F.lit("")), F.col("filename"))).alias("section_code"))


def _leachables(docs: DataFrame) -> DataFrame:
    head = F.substring("said", 1, 3000)
    return _whole(docs).where(F.contains(head, F.lit("extractable")) & F.contains(head, F.lit("leachable")))


def component_coverage(docs: DataFrame) -> DataFrame:
    """Components that a table lists without the test that it lists for others; a component's label holds for the rows below it."""
    df = grid_rows(docs).join(_leachables(docs).select("doc_id"), "doc_id", "left_semi")
    name = F.lower(F.regexp_replace(text.strip(F.col("title")), r"\s+", " "))
    df = df.withColumns({"key": F.when(name == "", F.concat(F.lit("__page_"), F.col("page_number").cast("string"))).otherwise(name), "line": F.array_join(F.transform("row", lambda c: F.coalesce(c, F.lit(""))), " ")})
    low = F.lower("line")
    hit = reduce(lambda a, c: F.when(F.contains(low, F.lit(c)), F.lit(c)).otherwise(a), fixed.COMPONENTS, F.lit(None).cast("string"))
    df = sequences.fill_forward(df, ["doc_id", "key"], ["page_ord", "table_ord", "row_ord"], hit, "current")
    df = df.withColumns({"tested": F.col("line").rlike(fixed.USP88), "named": F.filter(F.array(*map(F.lit, fixed.COMPONENTS)), lambda c: F.contains(low, c))})
    per = df.groupBy("doc_id", "key").agg(
        F.array_distinct(F.flatten(F.collect_list("named"))).alias("seen"), F.collect_set(F.when(F.col("tested"), F.col("current"))).alias("covered"),
        F.min_by("page_number", F.struct("page_ord", "table_ord", "row_ord")).alias("page"), F.min_by("title", F.struct("page_ord", "table_ord", "row_ord")).alias("title"),
    )
    have = F.array_intersect(F.array(*map(F.lit, fixed.COMPONENTS)), F.array_intersect("seen", "covered"))
    per = per.withColumns({"have": have, "missing": F.array_except(F.array_intersect(F.array(*map(F.lit, fixed.COMPONENTS)), F.col("seen")), F.col("covered"))})
    per = per.where("size(have) > 0 AND size(missing) > 0").select("*", F.posexplode("missing").alias("i", "component"))
    return _finding(
        per, ord=_place("page", "i"), title=F.concat(F.lit("USP <88> not performed for "), F.initcap("component")), detail=F.concat(F.lit("The test is listed for "), F.array_join("have", ", "), F.lit(" only.")),
        category="container_closure_inadequate", severity="high", tier="corroborated", evidence_class="checklist", confidence=0.7, evidence=F.concat(F.lit("present for "), F.array_join("have", ", "), F.lit("; absent for "), F.col("component")),
        page=F.col("page"), table_ref=F.substring(F.coalesce("title", F.lit("")), 1, 80), source="checklist:usp88_coverage",
    )


def missing_commitment(docs: DataFrame) -> DataFrame:
    """Extractables reports that commit to no further monitoring."""
    return _finding(
        _leachables(docs).where(~F.col("said").rlike(fixed.COMMITMENT)), title="No commitment to continue leachable monitoring", detail="The report nowhere commits to go on monitoring leachables through the shelf life.",
        category="commitment_missing", severity="medium", tier="corroborated", evidence_class="checklist", confidence=0.6, evidence="No words of commitment were found.", source="checklist:leachable_commitment",
    )


ORACLES: list[Callable[[DataFrame], DataFrame]] = [result_vs_limit, value_vs_inline_limit, conflicting_thresholds]
CHECKLISTS: list[Callable[[DataFrame], DataFrame]] = [missing_elements, component_coverage, missing_commitment]


def run(docs: DataFrame, checks: list[Callable[[DataFrame], DataFrame]] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All findings of the checks, in a fixed order: by check, then by place in the document.

    A check that fails is left out with a warning. Where `keep` is given, which writes a check's findings and
    returns them read again, that holds for failures while it runs, too; without it only for those while it is planned.
    """
    every = []
    for i, check in enumerate(checks or ORACLES + CHECKLISTS):
        try:
            found = check(docs).withColumn("_stage", F.lit(i))
            every.append(keep(found) if keep else found)
        except Exception as e:  # noqa: BLE001 - one check must not take the others with it
            warnings.warn(f"{getattr(check, '__name__', check)} failed: {e}", stacklevel=2)
    if not every:
        return docs.sparkSession.createDataFrame([], FINDING)
    df = reduce(DataFrame.unionByName, every)
    return df.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_stage", "ord", "title")).cast("long")).drop("_stage")


__all__ = ["CHECKLISTS", "ORACLES", "corpus", "run", "tables"]
