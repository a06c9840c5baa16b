"""Deduplication by authority, tiers, rescoring and ranking of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import ranked, squeeze


def priority_dedup(df: DataFrame, keys: list, authority: Column, order: list) -> DataFrame:
    """One row a key: the highest authority, and of those the first."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(authority.desc(), *order))
    return df.withColumn("_first", first).where("_first = 1").drop("_first")


def merged_precedents(rows: Column) -> Column:
    """Of structs (ord, authority, precedents) what the survivor keeps: the last list that came with a rise in authority, else the first.

    Rows are taken in order. A row that raises the highest authority so far brings its list, if it has one; any
    other row's list is only taken while there is none.
    """
    first = F.struct(F.lit(-1).alias("most"), F.filter(F.flatten(F.transform(rows, lambda r: r["precedents"])), lambda _: F.lit(False)).alias("list"))

    def step(acc: Column, r: Column) -> Column:
        has = F.coalesce(F.size(r["precedents"]), F.lit(0)) > 0
        takes = has & ((r["authority"] > acc["most"]) | (F.size(acc["list"]) == 0))
        return F.struct(F.greatest(acc["most"], r["authority"]).alias("most"), F.when(takes, r["precedents"]).otherwise(acc["list"]).alias("list"))

    return F.aggregate(F.array_sort(rows), first, step, lambda acc: acc["list"])


def rank_order() -> list[Column]:
    """Sort keys of findings: tier, severity, confidence from high to low, then the order in which they were made."""
    return [ranked(F.col("tier"), fixed.TIERS, 2), ranked(F.col("severity"), fixed.SEVERITIES, 1), F.col("confidence").desc(), F.col("ord")]


def verify_and_tier(findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """Anchors, tiers, scores, deduplicates and ranks findings (doc_id, ord, title, section, table_ref, evidence, ...).

    `corpus` has (doc_id, corpus): all text of a document, squeezed. A model's finding is anchored if its evidence, squeezed
    to four characters or more, occurs there. Null strings count as empty, null lists too.
    """
    said = squeeze(F.col("evidence"))
    firm = F.col("evidence_class").isin("code_verified", "checklist")
    anchored = (F.length(said) >= 4) & F.contains(F.coalesce("corpus", F.lit("")), said)
    backed = F.coalesce(F.size("precedents"), F.lit(0)) > 0
    score = F.when(backed, F.when(anchored, fixed.SCORES["quote", True]).otherwise(fixed.SCORES["judgment", True])).otherwise(F.when(anchored, fixed.SCORES["quote", False]).otherwise(fixed.SCORES["judgment", False]))
    df = findings.join(corpus, "doc_id", "left").withColumns({
        "_class": F.when(firm, F.col("evidence_class")).when(anchored, "quote_anchored").otherwise("model_judgment"),
        "tier": F.when(firm, F.col("tier")).when(backed, "corroborated").otherwise("advisory"),
        "confidence": F.when(firm, F.col("confidence")).otherwise(score),
        "novel": F.when(firm | backed, F.coalesce("novel", F.lit(False))).otherwise(True),
    })
    df = df.drop("corpus", "evidence_class").withColumnRenamed("_class", "evidence_class").withColumn("_auth", ranked(F.col("evidence_class"), fixed.AUTHORITY, 0))
    df = df.withColumn("_key", F.concat_ws("\u0001", F.substring(squeeze(F.col("title")), 1, 60), squeeze(F.col("section")), squeeze(F.col("table_ref"))))
    lists = df.groupBy("doc_id", "_key").agg(merged_precedents(F.collect_list(F.struct("ord", F.col("_auth").alias("authority"), "precedents"))).alias("_list"))
    kept = priority_dedup(df, ["doc_id", "_key"], F.col("_auth"), [F.col("ord")]).join(lists, ["doc_id", "_key"])
    kept = kept.withColumn("precedents", F.col("_list")).drop("_list", "_key", "_auth")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*rank_order())))


def rescore(confidence: Column, grounded: Column, verdict: Column) -> Column:
    """A grounded refutation leaves 0.4 of the confidence; a finding that survives gains 0.1, up to 0.9; no verdict changes nothing."""
    lower, higher = F.round(confidence * 0.4, 2), F.least(F.round(confidence + 0.1, 2), F.lit(0.9))
    return F.when(~verdict, confidence).when(grounded, lower).otherwise(higher)


def challenge(findings: DataFrame, verdicts: DataFrame, corpus: DataFrame, most: int = fixed.MOST_CHALLENGES) -> DataFrame:
    """Applies verdicts (doc_id, ord, refuted, counter_evidence) to the first `most` soft findings of a document, and ranks anew.

    Nothing is ever dropped. A refutation counts if its counter-evidence is found in the document.
    """
    soft = F.col("evidence_class").isin("model_judgment", "quote_anchored")
    place = F.row_number().over(Window.partitionBy("doc_id", soft).orderBy("rank"))
    df = findings.withColumn("_asked", soft & (place <= most)).join(verdicts, ["doc_id", "ord"], "left").join(corpus, "doc_id", "left")
    said = squeeze(F.col("counter_evidence"))
    grounded = F.coalesce(F.col("refuted"), F.lit(False)) & (F.length(said) >= 4) & F.contains(F.coalesce("corpus", F.lit("")), said)
    has = F.col("_asked") & F.col("refuted").isNotNull()
    df = df.withColumns({
        "confidence": rescore(F.col("confidence"), grounded, has),
        "tier": F.when(has & grounded, "advisory").otherwise(F.col("tier")),
        "challenge_note": F.when(has & grounded, F.substring(F.trim("counter_evidence"), 1, 300)).otherwise(""),
    }).drop("_asked", "refuted", "counter_evidence", "corpus", "rank")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*rank_order())))


def report(findings: DataFrame, by: str = "doc_id") -> DataFrame:
    """One JSON report a document, its findings in order of rank."""
    one = F.struct(*[F.col(c) for c in findings.columns if c != by])
    rows = findings.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("finding")))).alias("r"))
    return rows.select(by, F.to_json(F.struct(F.transform("r", lambda x: x["finding"]).alias("faults"), (F.size("r") > 0).alias("faults_found"))).alias("report"))
