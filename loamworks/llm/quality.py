"""Quality from weak labels: EM over overlapping heuristics, and a hashed linear scorer of its posteriors."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BYTES, one_text, table
from .toxicity import Sparse, _lists, fit

BITS = 18
BAD, GOOD, ABSTAIN = 0, 1, 2
SHAPES = ((re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[0-9]+"), "0"), (re.compile(r"([^aA0])\1+"), r"\1"))


@lru_cache(maxsize=50_000)
def shape(word: str) -> str:
    for rule, to in SHAPES:
        word = rule.sub(to, word)
    return word[:8]


@lru_cache(maxsize=50_000)
def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) >> (32 - BITS)


def facts(text: str) -> tuple[list[str], Counter, int, float]:
    words = text.split()
    seen = Counter(words)
    return words, seen, max(1, len(words)), sum(map(eq, words, words[1:])) / max(1, len(words) - 1)


def vote(text: str) -> list[int]:
    """The labellers' votes on a whole text. They overlap: every kind of junk can be seen by two at least."""
    words, seen, n, again = facts(text)
    shapes: Counter = Counter()
    for w, c in seen.items():
        shapes[shape(w)] += c
    plain = sum(c for s, c in shapes.items() if s.rstrip(".,;:!?") in ("a", "Aa", "A0", "a0", "0")) / n
    signs = sum(c for s, c in shapes.items() if any(x in "#$%&*@^~" for x in s)) / n
    caps = sum(c for s, c in shapes.items() if s.rstrip(".,;:!?") == "A") / n
    stops = sum(c for s, c in shapes.items() if s[-1:] in ".?") / n
    chars = max(1, len(text))
    bars, bangs = text.count("|"), text.count("!")
    lines = text.split("\n")
    if_ = lambda bad, good=False: BAD if bad else GOOD if good else ABSTAIN
    return [
        if_(signs > 0.2),
        if_(sum(text.count(x) for x in "#$%&*") / chars > 0.05),
        if_(caps > 0.4),
        if_(bangs / n > 0.3),
        if_(bars / n > 0.15),
        if_(bars / chars > 0.02, plain > 0.95 and again < 0.05),
        if_(again > 0.2, again < 0.02 and n >= 20 and plain > 0.8),
        if_(n >= 20 and len(seen) / n < 0.08, len(seen) / n > 0.4 and plain > 0.8),
        if_(plain < 0.4, plain > 0.9 and stops > 0.005 and again < 0.1),
        if_(len(lines) >= 5 and len(set(lines)) / len(lines) < 0.3),
    ]


def traits(text: str) -> dict[int, float]:
    """Hashed features: shares of word shapes, of words said twice running, and of distinct words."""
    words, seen, n, again = facts(text)
    out: dict[int, float] = {}
    for w, c in seen.items():
        f = slot("s:" + shape(w))
        out[f] = out.get(f, 0.0) + c / n
    for name in (f"again:{int(again * 10)}", f"distinct:{int(10 * len(seen) / n)}:{n.bit_length() // 3}", "empty" if not words else "words"):
        out[slot(name)] = 1.0
    return out


def _votes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, vote(t or ""))) for t in b.column(0).to_pylist()], pa.string())], ["votes"])


def _traits(batches):
    i, v = pa.list_(pa.int32()), pa.list_(pa.float32())
    for b in batches:
        texts = b.column(1).to_pylist()
        rows = [traits(t or "") for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(map(str, vote(t or ""))) for t in texts], pa.string()), pa.array([list(r) for r in rows], i), pa.array([list(r.values()) for r in rows], v)], ["key", "votes", "i", "v"])


def em(patterns: dict[str, int], steps: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good for each vote pattern, and each labeller's chances of its votes by class.

    Expectation-maximisation of a two-class model in which the labellers err independently,
    started from the majority. Counts are smoothed, and classes keep their sense because a
    labeller's good votes start as likelier in good texts.
    """
    if not patterns:
        return {}, np.zeros((0, 2, 3))
    keys = list(patterns)
    votes, n = np.array([[int(c) for c in k] for k in keys]), np.array([patterns[k] for k in keys], float)
    good = ((votes == GOOD).sum(1) + 0.5) / ((votes != ABSTAIN).sum(1) + 1)
    bad = (votes == BAD).any(1)
    good = np.where(bad, np.minimum(good, 0.2), np.maximum(good, 0.6))
    one = np.stack([votes == k for k in (BAD, GOOD, ABSTAIN)], 2).astype(float)  # pattern, labeller, vote
    chance = np.zeros((votes.shape[1], 2, 3))
    for _ in range(steps):
        for c, p in ((0, 1 - good), (1, good)):
            chance[:, c] = np.einsum("p,plv->lv", n * p, one) + 0.5
            chance[:, c] /= chance[:, c].sum(1, keepdims=True)
        prior = np.clip((n * good).sum() / n.sum(), 1e-3, 1 - 1e-3)
        side = [np.log(q) + np.einsum("plv,lv->p", one, np.log(chance[:, c])) for c, q in ((0, 1 - prior), (1, prior))]
        good = 1 / (1 + np.exp(np.clip(side[0] - side[1], -50, 50)))
    return dict(zip(keys, good.tolist(), strict=True)), chance


def scorer(weights):
    def run(batches):
        w = weights.value
        for b in batches:
            z = [w[-1] + sum(w[f] * x for f, x in traits(t or "").items()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50))))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, max_train: int = 8000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, score (0 to 1, higher is better), kept (score >= 0.5) of every whole text. No labels are used.

    The votes of all documents are counted by pattern (at most 3 to the power of the number of
    labellers rows reach the driver); EM turns patterns into posteriors. A linear model over
    hashed features is fitted to the posteriors of at most `max_train` documents, those with the
    smallest hash of doc_id, whose texts have `most_bytes` together at most, and scores every document.

    Null or empty text: scored as no words. Very long texts: voted on and scored whole. Other columns: not
    read. Repeated rows: each gets its row, and one of them is
    trained on. Null doc_id: scored, never trained on. Empty table: no rows.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    patterns = {r[0]: r[1] for r in text.mapInArrow(_votes, "votes string").groupBy("votes").count().collect()}
    good, _ = em(patterns)
    pick = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    got = one_text(docs, pick, most_bytes).mapInArrow(_traits, "key long, votes string, i array<int>, v array<float>").toArrow()
    got = got.sort_by("key")  # the order of sums, whichever task was first
    y = np.array([good.get(k, 0.5) for k in got.column(1).to_pylist()])
    w = fit(Sparse(_lists(got.column(2)), _lists(got.column(3))), y, Sparse([], []), l1=1e-5, steps=400)
    sent = spark.sparkContext.broadcast(w.astype(np.float32))  # 2^BITS + 1 numbers, 1 MB
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scorer(sent), "doc_id long, score double")
    return out.withColumn("kept", F.col("score") >= 0.5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
