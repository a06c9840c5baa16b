"""Review domains: choosing them, the sections each needs, and the context of a challenge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import table_number


def _any(said: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(said, t))


def fallback(said: Column) -> Column:
    """The domains whose words occur in a text, in their order; three defaults if none does. The text is lowered once."""
    return F.transform(F.array(F.lower(F.coalesce(said, F.lit("")))), _suggested)[0]


def _suggested(low: Column) -> Column:
    hits = [F.when(reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False)), F.lit(name)) for name, words in fixed.DOMAIN_HINTS]
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, fixed.DEFAULT_DOMAINS)))


def chosen(answer: Column, said: Column, catalog: list[str]) -> Column:
    """Of a model's answer the known domains, each once and in the answer's order, eight at most; the fallback if there are none."""
    named = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\[.*\]", 0), "array<string>")
    trimmed = F.transform(F.coalesce(named, F.array().cast("array<string>")), lambda d: F.trim(d))
    known = F.slice(F.array_distinct(F.filter(trimmed, lambda d: d.isin(catalog))), 1, fixed.MOST_DOMAINS)
    return F.when(F.size(known) > 0, known).otherwise(fallback(said))


def terms(domain: Column) -> Column:
    """The words of a domain's name and those that suggest it."""
    hints = reduce(lambda a, h: F.when(domain == h[0], F.array(*map(F.lit, h[1]))).otherwise(a), fixed.DOMAIN_HINTS, F.array().cast("array<string>"))
    return F.array_union(F.split(domain, "-"), hints)


def scope(domains: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, domain, section_ord) for the sections that mention a domain; all of a document's where none does."""
    both = domains.join(sections.select("doc_id", "section_ord", F.lower(F.concat_ws(" ", "heading", "text")).alias("_t")), "doc_id")
    both = both.withColumn("_hit", _any(F.col("_t"), terms(F.col("domain"))))
    return both.withColumn("_any", F.bool_or("_hit").over(Window.partitionBy("doc_id", "domain"))).where("_hit OR NOT _any").select("doc_id", "domain", "section_ord")


def context(findings: DataFrame, sections: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, ord, section_ord, way) of the sections that a finding's challenger reads: those with the table it names (way 0), then those whose heading holds its section or is held by it (1); all (2) where there are none.

    `titles` has the titles of the tables in each section (doc_id, section_ord, title). Sections grow as the documents do, and are never broadcast.
    """
    f = findings.select("doc_id", "ord", table_number(F.col("table_ref")).alias("_n"), F.lower(F.coalesce("section", F.lit(""))).alias("_s"))
    t = titles.select("doc_id", "section_ord", table_number(F.col("title")).alias("_n")).where("_n <> ''").distinct().hint("merge")
    by_table = f.where("_n <> ''").join(t, ["doc_id", "_n"]).select("doc_id", "ord", "section_ord", F.lit(0).alias("way"))
    heads = sections.select("doc_id", "section_ord", F.lower("heading").alias("_h")).where("_h <> ''").hint("merge")
    by_head = f.where("_s <> ''").join(heads, "doc_id").where(F.contains("_h", F.col("_s")) | F.contains("_s", F.col("_h"))).select("doc_id", "ord", "section_ord", F.lit(1).alias("way"))
    some = by_table.unionByName(by_head).groupBy("doc_id", "ord", "section_ord").agg(F.min("way").alias("way"))
    rest = f.select("doc_id", "ord").join(some, ["doc_id", "ord"], "left_anti").join(sections.select("doc_id", "section_ord").hint("merge"), "doc_id").withColumn("way", F.lit(2))
    return some.unionByName(rest)


def digest(headings: Column) -> Column:
    """The first forty headings, a line each."""
    return F.concat(F.lit("Section headings:\n"), F.array_join(F.transform(F.slice(F.filter(headings, lambda h: F.coalesce(h, F.lit("")) != ""), 1, 40), lambda h: F.concat(F.lit("- "), h)), "\n"))


def precedent_lines(precedents: Column, most: int = 3) -> Column:
    """Retrieved precedents as lines for a prompt."""
    return F.array_join(F.transform(F.slice(precedents, 1, most), lambda p: F.concat(F.lit("- ["), F.coalesce(F.nullif(p["product_name"], F.lit("")), F.lit("unknown")), F.lit("] "), F.substring(p["deficiency_text"], 1, 280))), "\n")
