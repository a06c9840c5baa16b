"""The calls of a review as rows: what specialists, reviewers, challengers and the selector are asked, and what is made of their answers.

Instructions are texts of the caller; work items are (item_id, prompt, ...) for `model_calls.fan_out`. All text of an item
belongs to one document and is cut by the budgets of `rendering`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import domains as scopes
from . import model_calls, rendering

PRECEDENT = (("anda_number", "string", ""), ("product_name", "string", ""), ("deficiency_text", "string", ""), ("similarity_score", "double", 0.0))


def _none() -> Column:
    return F.array().cast("array<struct<anda_number: string, product_name: string, deficiency_text: string, similarity_score: double>>")


def catalog_lines(rows: Column) -> Column:
    """A line for each domain of an array of structs (name, description), in its order."""
    return F.array_join(F.transform(rows, lambda d: F.concat(F.lit("- "), d["name"], F.lit(": "), F.coalesce(d["description"], F.lit("")))), "\n")


def precedent(hits: DataFrame) -> Column:
    """The precedent that a retrieved row is: four fields, with defaults for columns that are missing or null."""
    has = set(hits.columns)
    return F.struct(*[(F.coalesce(F.col(c).cast(kind), F.lit(none)) if c in has else F.lit(none)).alias(c) for c, kind, none in PRECEDENT])


def by_domain(domains: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, domain, precedents) for every row of `domains`: the hits (doc_id, domain, rank, ...; a few each) in order of rank, an empty list where there are none."""
    found = hits.select("doc_id", "domain", F.struct("rank", precedent(hits).alias("p")).alias("_hit"))
    lists = found.groupBy("doc_id", "domain").agg(F.transform(F.array_sort(F.collect_list("_hit")), lambda h: h["p"]).alias("precedents"))
    return domains.join(lists, ["doc_id", "domain"], "left").withColumn("precedents", F.coalesce("precedents", _none()))


def _item(df: DataFrame, prompt: Column, *more: str) -> DataFrame:
    return df.select(F.xxhash64("doc_id", "source", *more).alias("item_id"), prompt.alias("prompt"), "doc_id", "source", *more, "precedents")


def _documents(sections: DataFrame) -> DataFrame:
    """A row a document with its rendered sections in order, `_all`: text moves once, however many items quote it.

    Sizes that are guessed from columns say little of texts, so these are never broadcast.
    """
    return sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_ord", "rendered"))).alias("_all")).hint("merge")


def _picked(ords: Column) -> Column:
    """Of `_all` the sections with one of the given places; none where either is null."""
    some = F.transform(F.filter("_all", lambda s: F.array_contains(ords, s["section_ord"])), lambda s: s["rendered"])
    return F.coalesce(some, F.array().cast("array<string>"))


def specialist_work(domains: DataFrame, sections: DataFrame, instruction: str) -> DataFrame:
    """One item a document and domain: the instruction, the domain with its precedents, and the sections that mention it.

    `domains` has (doc_id, domain, description, precedents), `sections` (doc_id, section_ord, heading, text, rendered).
    """
    ords = scopes.scope(domains.select("doc_id", "domain"), sections).groupBy("doc_id", "domain").agg(F.collect_set("section_ord").alias("_ords"))
    df = domains.join(ords, ["doc_id", "domain"], "left").join(_documents(sections), "doc_id", "left").withColumn("source", F.concat(F.lit("specialist:"), "domain"))
    about = F.concat("domain", F.lit(": "), F.coalesce("description", F.lit("")))
    known = F.nullif(scopes.precedent_lines(F.col("precedents")), F.lit(""))
    return _item(df, F.concat_ws("\n\n", F.lit(instruction), about, known, rendering.within_budget(_picked(F.col("_ords")), fixed.SECTION_BUDGET)))


def reviewer_work(sections: DataFrame, instruction: str) -> DataFrame:
    """One item a group of sections (doc_id, group_id, section_ord, rendered); reviewers see no precedents."""
    groups = sections.groupBy("doc_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("section_ord", "rendered"))).alias("_all"))
    df = groups.withColumns({"source": F.concat(F.lit("reviewer:"), F.col("group_id").cast("string")), "precedents": _none()})
    return _item(df, F.concat_ws("\n\n", F.lit(instruction), rendering.within_budget(F.transform("_all", lambda s: s["rendered"]), fixed.SECTION_BUDGET)))


def challenge_work(findings: DataFrame, sections: DataFrame, titles: DataFrame, instruction: str) -> DataFrame:
    """(item_id, prompt, doc_id, ord): one item a finding, with the sections that it names (by table, then by heading), else with all, each within its budget."""
    ords = [F.collect_set(F.when(F.col("way") == way, F.col("section_ord"))).alias(f"_way{way}") for way in range(3)]
    read = scopes.context(findings, sections, titles).groupBy("doc_id", "ord").agg(*ords)
    df = findings.join(read, ["doc_id", "ord"], "left").join(_documents(sections), "doc_id", "left")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("")))
    named = F.concat(_picked(F.col("_way0")), _picked(F.col("_way1")))
    said = F.concat_ws("\n", F.lit(instruction), line("Finding", "title"), line("Why", "detail"), line("Quoted", "evidence"), F.lit("From the document:"), rendering.challenge_text(named, _picked(F.col("_way2"))))
    return df.select(F.xxhash64("doc_id", "ord").alias("item_id"), said.alias("prompt"), "doc_id", "ord")


def selector_work(docs: DataFrame, catalog: Column, instruction: str) -> DataFrame:
    """(item_id, prompt, doc_id, said): which domains a document (doc_id, filename, headings, said) is to be reviewed for."""
    said = F.concat_ws("\n\n", F.lit(instruction), catalog, F.concat(F.lit("Document: "), F.coalesce("filename", F.lit(""))), scopes.digest(F.col("headings")))
    return docs.select(F.xxhash64("doc_id").alias("item_id"), said.alias("prompt"), "doc_id", "said")


def selected(work: DataFrame, answers: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, domains): what the selector named, or what the text suggests where its call failed or named nothing known."""
    df = work.select("item_id", "doc_id", "said").join(answers.select("item_id", "raw_output"), "item_id", "left")
    return df.select("doc_id", scopes.chosen(F.col("raw_output"), F.col("said"), names).alias("domains"))


def faults(answers: DataFrame, work: DataFrame) -> DataFrame:
    """The findings of specialists and reviewers, with the source and precedents of their work item, as judgments that nothing backs yet."""
    kind = dict(evidence_class="model_judgment", tier="advisory")
    return model_calls.findings(answers, work).withColumns({c: F.lit(v) for c, v in kind.items()}).withColumnRenamed("finding_ord", "ord")
