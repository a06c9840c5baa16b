"""Markdown of tables and sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import markdown_cell, markdown_row


def markdown_grid(headers: Column, rows: Column) -> Column:
    """A grid: header, rule, and rows."""
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(markdown_row(headers), rule), F.transform(rows, markdown_row)), "\n")


def markdown_pairs(pairs: Column) -> Column:
    """Label and value pairs as a list."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("- "), markdown_cell(p["label"]), F.lit(": "), markdown_cell(p["value"]))), "\n")


def caption(title: Column, page: Column) -> Column:
    """The line above a table; empty without a title."""
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("**"), markdown_cell(title), F.lit("** (p."), page.cast("string"), F.lit(")")))


def markdown_section(heading: Column, first: Column, last: Column, text: Column, tables: Column) -> Column:
    """Heading with its pages, prose, and the rendered tables, with blank lines between."""
    pages = F.when(first == last, F.concat(F.lit("(p."), first.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("(pp."), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")")))
    parts = F.concat(F.array(F.concat(F.lit("## "), heading, F.lit(" "), pages), F.trim(text)), F.coalesce(tables, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")


# What stands between rendered sections, and in place of those left out.
BETWEEN, OMITTED = "\n\n---\n\n", "\n[... further sections omitted for length ...]"


def within_budget(pieces: Column, budget: int | Column) -> Column:
    """Rendered sections in order until the next would exceed the budget in characters; the first always stays, and a mark says that others are left out."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    first = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"))

    def step(acc: Column, piece: Column) -> Column:
        full = acc["full"] | ((acc["used"] + F.length(piece) > budget) & (F.size(acc["out"]) > 0))
        out = F.when(acc["full"], acc["out"]).when(full, F.concat(acc["out"], F.array(F.lit(OMITTED)))).otherwise(F.concat(acc["out"], F.array(piece)))
        return F.struct(out.alias("out"), F.when(full, acc["used"]).otherwise(acc["used"] + F.length(piece)).alias("used"), full.alias("full"))

    return F.aggregate(F.filter(pieces, lambda p: F.coalesce(p, F.lit("")) != ""), first, step, lambda acc: F.array_join(acc["out"], BETWEEN))


def challenge_text(picked: Column, every: Column) -> Column:
    """What a challenger reads: the sections that a finding names, else all, each within its own budget."""
    return F.when(F.size(picked) > 0, within_budget(picked, fixed.PICKED_BUDGET)).otherwise(within_budget(every, fixed.WIDE_BUDGET))
