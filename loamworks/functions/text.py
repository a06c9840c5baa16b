"""Scalar rules as Column functions; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Lower case, without any white space; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")


def number(c: Column) -> Column:
    """A measured value: the first signed number, or null where the text says that there is none."""
    none = F.coalesce(c, F.lit("")).rlike(r"(?iU)\bnd\b|not detected|n/?a")
    got = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"[-+]?\d+(?:\.\d+)?", 0)
    return F.when(~none, got.try_cast("double"))


def limit(c: Column) -> Column:
    """An acceptance criterion as struct<kind, low, high>: a range, else a maximum, else a minimum, else null."""
    s = F.replace(F.coalesce(c, F.lit("")), F.lit("%"), F.lit(" "))
    nums = F.transform(F.regexp_extract_all(s, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    none = F.lit(None).cast("double")
    of = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
    return (
        F.when((F.size(nums) >= 2) & s.rlike("(?i)-|–|to|between"), of("range", F.array_min(nums), F.array_max(nums)))
        .when((F.size(nums) >= 1) & s.rlike("(?i)nmt|not more than|≤|<=|<|max"), of("max", none, F.get(nums, F.lit(0))))
        .when((F.size(nums) >= 1) & s.rlike("(?i)nlt|not less than|≥|>=|>|min"), of("min", F.get(nums, F.lit(0)), none))
    )


def satisfies(value: Column, lim: Column) -> Column:
    """Whether a value keeps to a limit, ends included; null without either."""
    return (value >= F.coalesce(lim["low"], F.lit(float("-inf")))) & (value <= F.coalesce(lim["high"], F.lit(float("inf"))))


def inline(c: Column) -> tuple[Column, Column]:
    """Of a cell such as `1.8 (NMT 6.0)` the value before the first bracket that closes, and the limit in it."""
    parts = r"(?s)^(.*?)\(([^)]*)\)"
    found = c.rlike(parts)
    return F.when(found, number(F.regexp_extract(c, parts, 1))), F.when(found, limit(F.regexp_extract(c, parts, 2)))


def broken(value: Column, lim: Column) -> Column:
    """An array of the one struct<value, lim> if the value breaks the limit, else an empty one. Exploding it tests and keeps what was parsed once, where a filter would parse it again."""
    return F.filter(F.array(F.struct(value.alias("value"), lim.alias("lim"))), lambda x: ~satisfies(x["value"], x["lim"]))


def column_like(headers: Column, keys: tuple[str, ...]) -> Column:
    """The place, from 0, of the first header that contains one of the keys; null if none does."""
    hit = F.transform(headers, lambda h: reduce(lambda a, k: a | F.contains(F.lower(F.coalesce(h, F.lit(""))), F.lit(k)), keys, F.lit(False)))
    return F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)) - 1


def first_match(c: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The name of the first pattern that is found; order is priority."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in rules:
        out = out.when(c.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(default))


def ctd_section(c: Column) -> Column:
    """The section code that a text names, by priority."""
    rules = [(r"(?i)3\.2\.\s*" + code[4:].replace(".", r"\.") + r"\b", code) for code in fixed.CTD_SECTIONS]
    return first_match(F.coalesce(c, F.lit("")), rules, fixed.UNKNOWN_SECTION)


def describe_section(code: Column) -> Column:
    kind = F.when(code.startswith("3.2.S"), "drug substance").when(code.startswith("3.2.P"), "drug product").otherwise("regional or appendix material")
    return F.when(code == fixed.UNKNOWN_SECTION, F.lit("an unidentified CTD section")).otherwise(F.concat(F.lit("CTD "), code, F.lit(" ("), kind, F.lit(")")))


def ranked(c: Column, ranks: tuple[tuple[str, int], ...], default: int | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in ranks:
        out = out.when(c == name, F.lit(rank))
    return out.otherwise(F.lit(default))


def table_number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)table\s*(\d+)", 1)


def page_label(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)page\s+(\d+)\s+of\s+\d+", 1)


def markdown_cell(c: Column) -> Column:
    return strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | "), F.lit(" |"))


def summary(c: Column, pieces: int = 3, default: str = "Address the identified deficiency per FDA guidance.") -> Column:
    """The first pieces between full stops; the first 200 characters where those are blank."""
    parts = F.filter(F.transform(F.slice(F.split(F.replace(c, F.lit("\n"), F.lit(" ")), r"\."), 1, pieces), strip), lambda x: x != "")
    said = F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ". "), F.lit("."))).otherwise(F.substring(c, 1, 200))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(default)).otherwise(said)


def section_number(c: Column) -> tuple[Column, Column]:
    """Number and title of a heading such as `1.4.2 Linearity`; empty where it is none."""
    rule = r"(?sU)^\s*(\d+(?:\.\d+)*)\.?\s+(.+)"
    return F.regexp_extract(F.coalesce(c, F.lit("")), rule, 1), strip(F.regexp_extract(F.coalesce(c, F.lit("")), rule, 2))


def plausible_number(num: Column) -> Column:
    """One to four parts of at most 50: others are data."""
    parts = F.split(num, r"\.")
    return (num != "") & (F.size(parts) <= 4) & F.forall(parts, lambda p: F.coalesce(p.try_cast("int"), F.lit(99)) <= 50)


def collapse_near(values: Column, share: float = 0.01, least: float = 0.001) -> Column:
    """Ascending distinct values without those within `share` (or `least`) of one that is kept."""
    near = lambda v, k: F.abs(v - k) <= F.greatest(F.lit(least), k * share)
    keep = lambda kept, v: F.when(F.exists(kept, lambda k: near(v, k)), kept).otherwise(F.concat(kept, F.array(v)))
    return F.aggregate(F.array_sort(F.array_distinct(values)), F.array().cast("array<double>"), keep)


def json_blob(c: Column) -> Column:
    """What is inside a code fence, else the outermost object, else the outermost array, else the stripped text."""
    s = strip(c)
    fence = F.regexp_extract(s, r"(?s)```(?:[^\n]{0,19}\n)?(.*)```", 1)
    pick = lambda rule: F.regexp_extract(s, rule, 0)
    return F.coalesce(F.nullif(strip(fence), F.lit("")), F.nullif(pick(r"(?s)\{.*\}"), F.lit("")), F.nullif(pick(r"(?s)\[.*\]"), F.lit("")), s)
