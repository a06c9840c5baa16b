"""Toxicity by a linear classifier that is held to counterfactual fairness."""

from __future__ import annotations

import re
import warnings
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BYTES, lean, one_text, table

BITS = 18
THRESHOLD = 0.3
#: Groups of terms that name people neutrally; a term is swapped for each other one of its group.
IDENTITY = (
    ("women", "men", "nonbinary"),
    ("woman", "man"),
    ("she", "he", "they"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("immigrant", "refugee", "native", "citizen"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young"),
)
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
EDGE = ".,;:!?\"'()[]{}<>*#%$&|-_"


@lru_cache(maxsize=20_000)
def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and, of longer words, how it begins."""
    w = word.strip(EDGE)
    if not w:
        return ()
    names = [f"w:{w}"] + [f"{n}:{w[:n]}" for n in (4, 5, 6) if len(w) > n]
    return tuple({zlib.crc32(x.encode("utf-8", "replace")) >> (32 - BITS) for x in names})


def counts(words: set[str]) -> dict[int, int]:
    out: dict[int, int] = {}
    for w in words:
        for f in features(w):
            out[f] = out.get(f, 0) + 1
    return out


def swaps(text: str, groups: tuple[tuple[str, ...], ...]) -> list[dict[int, int]]:
    """For every sentence that names a group, and each way to swap the terms, the change of the sentence's features."""
    turn = {t: g for g in groups for t in g}
    out = []
    for sentence in SENTENCE.split(text.lower()):
        words = sentence.split()
        if not any(w.strip(EDGE) in turn for w in words):
            continue
        old = counts(set(words))
        for k in range(1, max(len(turn[w.strip(EDGE)]) for w in words if w.strip(EDGE) in turn)):
            other = [(g := turn.get(w.strip(EDGE))) and g[(g.index(w.strip(EDGE)) + k) % len(g)] or w for w in words]
            new = counts(set(other))
            change = {f: new.get(f, 0) - old.get(f, 0) for f in {*old, *new}}
            if change := {f: c for f, c in change.items() if c}:
                out.append(change)
    return out


def _examples(groups):
    """Rows (key, label, indices, values): a labelled text's features, or with a null label the change that a swap makes."""
    schema = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("i", pa.list_(pa.int32())), ("v", pa.list_(pa.float32()))])

    def run(batches):
        for b in batches:
            for key, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = [(label, counts(set((text or "").lower().split())))] + [(None, x) for x in swaps(text or "", groups)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([list(r[1]) for r in rows], schema.field(2).type), pa.array([list(map(float, r[1].values())) for r in rows], schema.field(3).type)], schema=schema)

    return run


class Sparse:
    """Rows of (indices, values) with products in both directions."""

    def __init__(self, i: list[np.ndarray], v: list[np.ndarray]):
        self.n = len(i)
        self.col = np.concatenate(i).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.val = np.concatenate(v).astype(float) if self.n else np.zeros(0)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in i]) if self.n else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n).astype(float)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], size).astype(float)


def fit(x: Sparse, y: np.ndarray, change: Sparse, fairness: float = 1.0, l1: float = 2e-4, l2: float = 1e-5, steps: int = 150) -> np.ndarray:
    """Weights, the last one for a constant, of a logistic model by accelerated proximal gradient steps.

    Minimises the mean log-loss + fairness * mean (score change under a swap)^2 + l2 |w|^2 + l1 |w|_1.
    A feature's step follows how often and how strongly it occurs.
    """
    size = (1 << BITS) + 1
    n = max(1, x.n)
    bend = np.bincount(x.col, x.val**2, size).astype(float) * 0.25 / n
    if change.n:
        bend += 2 * fairness * np.bincount(change.col, change.val**2, size) / change.n
    bend[-1] = 0.25
    rate = 1 / (np.maximum(bend, 1e-5) * 12)
    w, old = np.zeros(size), np.zeros(size)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w[-1] = old[-1] = np.log(share / (1 - share))
    for k in range(steps):
        z = w + (k / (k + 3)) * (w - old)
        p = 1 / (1 + np.exp(-np.clip(x.dot(z[:-1]) + z[-1], -50, 50)))
        g = np.append(x.back((p - y) / n, size - 1), (p - y).mean() if x.n else 0)
        if change.n:
            g[:-1] += 2 * fairness * change.back(change.dot(z[:-1]) / change.n, size - 1)
        g[:-1] += 2 * l2 * z[:-1]
        new = z - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - l1 * rate[:-1])
        w, old = new, w
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = 6000, groups=IDENTITY, fairness: float = 1.0, most_bytes: int = MOST_BYTES) -> np.ndarray:
    """Fits on at most `max_train` labelled documents, those with the smallest hash of doc_id.

    Their texts have `most_bytes` together at most: that bounds what the driver gathers, some 8 bytes a
    feature of a distinct word. Null labels and null doc_ids are
    left out; of several labels of a document the largest counts, of several texts the least.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    pick = lab.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    got = one_text(docs, pick, most_bytes).mapInArrow(lean(_examples(groups)), "key long, label int, i array<int>, v array<float>").toArrow()
    got = got.sort_by("key")  # the order of sums, whichever task was first
    label_, i, v = got.column(1).to_pylist(), *(_lists(got.column(k)) for k in (2, 3))
    own = [k for k, y in enumerate(label_) if y is not None]
    swap = [k for k, y in enumerate(label_) if y is None]
    y = np.array([label_[k] for k in own], float)
    return fit(Sparse([i[k] for k in own], [v[k] for k in own]), y, Sparse([i[k] for k in swap], [v[k] for k in swap]), fairness)


def _lists(col: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for c in col.chunks:
        off, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        out += [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    return out


def scorer(weights):
    def run(batches):
        w = weights.value
        known: dict[str, float] = {}
        for b in batches:
            out = np.empty(b.num_rows)
            texts = b.column(1)
            for k in range(b.num_rows):
                z = w[-1]
                text = texts[k].as_py()
                if text:
                    words = set(text.lower().split())
                    if len(known) > 250_000:
                        known.clear()
                    for x in words:
                        s = known.get(x)
                        if s is None:
                            known[x] = s = float(sum(w[f] for f in features(x)))
                        z += s
                out[k] = z
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1) of each whole text; null and empty texts get the constant's score."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2^BITS + 1 numbers, 1 MB
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(scorer(sent)), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def model(docs: DataFrame, labels: DataFrame, **how) -> np.ndarray:
    """The classifier, fitted on labelled documents that are not held out."""
    return train(docs, labels.where(~held_out(F.col("doc_id"))), **how)


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Only texts and labels of documents that are not held out are learned from, and only the
    text is scored. Null doc_id: held_out is null. Null or empty text: scored as no words. Very
    long texts: scored whole. Other columns: not read. No labels: every text scores 0.5. Repeated rows: each gets its row. Empty table: no rows.
    """
    out = score(docs, model(docs, labels, **how))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _clean(weights, place: int, threshold: float):
    score_ = scorer(weights)

    def run(batches):
        for b in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(place)], ["doc_id", "text"])
            for got in score_([pair]):
                yield b.filter(pa.array(got.column(1).to_numpy() < threshold))

    return run


def reject(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all their columns kept, that score below the threshold.

    A model without a weight for any word, as of no labelled row, tells no text from another: all documents stay.
    Null and empty texts: judged as no words. Very long texts: whole. Repeated rows: each by itself, alike. Null
    doc_id: as any other. Empty table: no rows. Other columns pass through, whatever their names.
    """
    if not weights[:-1].any():
        warnings.warn("no labelled row to learn toxicity from: every document is kept", stacklevel=2)
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    return docs.mapInArrow(lean(_clean(sent, docs.columns.index("text"), threshold)), docs.schema)
