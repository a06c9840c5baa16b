"""Mixing sources to target weights by a curriculum that changes over the training run."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, table, word_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (3.0, 1.0, 2.0)
#: How each source's weight changes over the run, in the same order: from 1 - a at its start to 1 + a at its end.
SLOPES = (0.6, 0.0, -0.6)


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(word_counts(b.column(3)))], ["doc_id", "source", "text_hash", "size"])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash and the number of words of each text."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(lean(_sizes), "doc_id long, source string, text_hash long, size long")


def cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, demand: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """source, rank, source_size, target: `demand` times all words, shared by weight, none above `repeats` times its source.

    One row per source. What is above a source's limit is shared out again by weight; in order
    of limit over weight the sources at their limit come first, so one pass of running sums
    finds the level at which the rest stops. Sources without words get 0.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank")
    per = per.select("source", "source_size", rank).withColumn("w", cycle(weights, F.col("rank"))).withColumn("most", F.col("source_size") * F.lit(repeats))
    up = Window.orderBy(F.col("most") / F.col("w"), "rank")
    all_ = Window.orderBy(F.col("most") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("most").over(up) - F.col("most")
    rest = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(all_) * F.lit(demand) - before) / rest)
    level = F.max(F.when(F.col("most") / F.col("w") > F.col("level"), F.col("level"))).over(all_)
    target = F.least("most", F.coalesce(F.col("w") * level, F.col("most")))
    return per.select("source", "rank", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def position(u: Column, a: Column) -> Column:
    """When a source whose weight runs from 1 - a to 1 + a has used the share u of its words: the inverse of t + a (t^2 - t)."""
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * u)
    return F.when(a == 0, u).otherwise((root - (1 - a)) / (2 * a) + 0.0)


def plan(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, demand: float = 1.5, repeats: float = 2.0, seed: int = 7, per_bucket: int = 4096) -> DataFrame:
    """What each document is for the mix: source, doc_id, text_hash, size, copies, rank, source_size, target and `at`, the words of its source before it.

    A source is read in the order of a seeded hash of doc_id and text. Rows alike in source, doc_id and text are one
    document with as many `copies`, counted by a pre-aggregated group-by, however many there are; each copy comes
    `size` words after the one before.

    Running sums come in two steps so that no source, however large, has to be in one task: sums
    per (source, bucket of the hash) first, then those inside a bucket of about `per_bucket` documents.
    Sources are named by a string that is never null, so one exchange serves the join and the sums in a bucket.
    """
    sized = sizes(docs).groupBy("source", "doc_id", "text_hash", "size").agg(F.count("*").alias("copies"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key")
    h = F.xxhash64("doc_id", "text_hash", F.lit(seed))
    sized = scratch.cut(sized.select(key, "source", "doc_id", "text_hash", "size", "copies", h.alias("h")), "sizes")
    buckets = 1 << max(8, (sized.count() // per_bucket).bit_length())
    keyed = sized.withColumn("bucket", F.shiftrightunsigned("h", 64 - buckets.bit_length() + 1))
    sums = keyed.groupBy("key", "source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    sums = scratch.cut(sums.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("n")), "sums")
    goal = targets(sums.select("source", F.col("n").alias("size")), weights, demand, repeats)
    goal = goal.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"), "rank", "source_size", "target")
    sums = sums.select("key", "bucket", "before").join(goal, "key")
    inner = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "text_hash", "size")
    rows = keyed.join(sums.hint("merge"), ["key", "bucket"])
    words = F.col("size") * F.col("copies")
    rows = rows.withColumn("at", F.col("before") + F.sum(words).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - words)
    return rows.select("source", "doc_id", "text_hash", "size", "copies", "rank", "source_size", "target", "at")


def each_copy(planned: DataFrame, chunk: int = 4096) -> DataFrame:
    """A row for each copy, with `copy` from 0, its own `at` and `taken`. Documents with many copies are dealt out in chunks first."""
    last = F.floor((F.col("copies") - 1) / chunk)
    rows = planned.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.where("chunk = 0").unionByName(rows.where("chunk > 0").repartition("doc_id", "text_hash", "chunk"))
    first = F.col("chunk") * chunk
    rows = rows.withColumn("copy", F.explode(F.sequence(first, F.least(first + chunk, F.col("copies")) - 1))).drop("chunk")
    rows = rows.withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    full = F.floor(F.col("target") / F.col("source_size"))
    left = F.floor(F.col("target") - full * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("at")))
    return rows.withColumn("taken", F.when(F.col("size") > 0, full * F.col("size") + last).otherwise(0).cast("long"))


def mix(docs: DataFrame, scratch: Scratch, slopes: tuple[float, ...] = SLOPES, **how) -> DataFrame:
    """One row per document: its words, its source's target, how often it is read and when first.

    A source is read in the order of `plan`, again and again, until its target is met; the document that
    the last round ends in is read up to the target's last whole word. A document's cumulative words, over its
    source's target, give its position in the run by the inverse of the integrated weight schedule.

    Rows alike in source, doc_id and text are interchangeable copies, each with a place of its own. Null
    source: a source of its own, last. Null or empty text: size 0, taken 0, no position. Null doc_id: as any
    other. Very long texts: counted whole. Empty table: no rows. Reruns agree. Other columns are not read.
    """
    rows = each_copy(plan(docs, scratch, **how))
    where = position(F.least(F.lit(1.0), F.col("at") / F.col("target")), cycle(slopes, F.col("rank")))
    return rows.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", "taken",
        F.col("at").alias("source_offset"), "rank", F.when(F.col("taken") > 0, where).alias("position"),
    )


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for m in itertools.islice(WORD.finditer(text), n):
        end = m.end()
    return text[:end]


def _cut(batches):
    """Cuts the texts of which the run reads fewer words than there are: rows of words, size and, last, text."""
    for b in batches:
        words, size = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("words", "size"))
        place = b.num_columns - 1
        part = np.flatnonzero(words < size)
        if len(part):
            texts = b.column(place).to_pylist()
            for i in part.tolist():
                texts[i] = first_words(texts[i], int(words[i]))
            b = b.set_column(place, b.schema.field(place).name, pa.array(texts, pa.string()))
        yield b


def curriculum(docs: DataFrame, scratch: Scratch, slopes: tuple[float, ...] = SLOPES, **how) -> DataFrame:
    """The documents as they are read: a row of `docs` for each time, range-sorted by position.

    The columns are those of docs, with `position`, `pass` and `words` after them; a column of docs that has one
    of these names is left out. Where fewer words than the document has are left of its source's target, the text
    ends with the last of them.

    Rows alike in source, doc_id and text are copies of one document: it is read as often as the mix reads all
    copies together, with the other columns of the first of them. Null or empty text, and what the mix does
    not read: no row. Null doc_id or source: as any other. Very long texts: whole. Empty table: no rows.
    """
    read = each_copy(plan(docs, scratch, **how)).where("taken > 0")
    read = read.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    share = (F.col("pass") * F.col("source_size") + F.col("at")) / F.col("target")
    read = read.select(
        F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "copy", "pass", (F.col("copies") > 1).alias("many"), "size",
        F.least("size", F.col("taken") - F.col("pass") * F.col("size")).alias("words"), position(F.least(F.lit(1.0), share), cycle(slopes, F.col("rank"))).alias("position"),
    )
    read = scratch.cut(read, "plan")
    names = [c for c in docs.columns if c.lower() not in ("position", "pass", "words")]
    # The columns of docs travel as one, so that their names can't clash with ours.
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_row")
    rows = docs.select(F.col("source").cast("string").alias("_source"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), rest, F.col("text").cast("string").alias("_text"))
    same = F.col("_source").eqNullSafe(F.col("_s")) & F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h"))
    out = rows.join(read.where("NOT many"), same)
    if not read.where("many").isEmpty():
        several = read.where("many").select("_s", "_d", "_h").distinct()
        first = rows.join(several, same, "left_semi").groupBy("_source", "_id", "_hash").agg(F.first("_row").alias("_row"), F.first("_text").alias("_text"))
        out = out.unionByName(first.join(read.where("many"), same))
    # Texts that are read whole stay out of Python; those that are not, a document of each source at most, are cut afterwards.
    part = (F.col("words") < F.col("size")).alias("part")
    out = scratch.cut(out.select("_row", "copy", "position", "pass", "words", "size", part, "_text"), "read")
    ends = scratch.cut(out.where("part").mapInArrow(lean(_cut), out.schema), "ends")
    out = out.where("NOT part").unionByName(ends).orderBy("position", "_row.doc_id", "pass", "copy")
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names], "position", "pass", "words")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")
