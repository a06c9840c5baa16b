"""Recall inside large nodes, boilerplate that most documents share, and the chance that trees miss a pair."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamworks.llm import minhash
from loamworks.llm.common import Scratch

from . import brute


def shared_page(pairs: int, seed=3):
    """Documents that share two thirds of their shingles, and each with a near copy at a similarity of 0.85 to 0.90."""
    r = random.Random(seed)
    page = [f"p{i}" for i in range(400)]
    rows = []
    for k in range(pairs):
        own = [f"w{r.randrange(10**6)}" for _ in range(200)]
        near = list(own)
        for place in range(4, 200, r.choice((25, 29, 33))):
            near[place] = "changed"
        rows += [(2 * k, " ".join(page + own)), (2 * k + 1, " ".join(page + near))]
    return rows


def test_recall_inside_large_nodes(spark):
    rows = shared_page(300)
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    alike = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(300)]
    assert min(alike) >= 0.85 and max(alike) <= 0.92
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for how in ({}, {"node_rows": 200, "cluster_rows": 20}):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, Scratch(spark), percent=85, **how).collect()}
        found = sum(got[2 * k + 1] == 2 * k for k in range(300))
        assert found >= 0.99 * 300 and len(set(got.values())) >= 300  # and no link between others


def test_boilerplate_makes_no_candidates(spark):
    """Documents at a similarity of two thirds are told apart by their sketches, so none of their sets is fetched."""
    texts = [t for i, t in shared_page(400) if i % 2 == 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.mapInArrow(minhash._sketches, "doc_id long, n long, h1 long, h2 long, sig binary").withColumn("rep", F.col("doc_id"))
    scratch = Scratch(spark)
    assert minhash.candidates(scratch.cut(rows), scratch, 85, 10, 8192).count() <= 8  # of 79,800 pairs


def test_sketch_tells_similarity():
    r = np.random.default_rng(2)
    for n in (6, 60, 600, 6000):
        for share, want in ((0.97, True), (0.60, False)):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            b = np.concatenate([a[: int(n * share)], r.integers(0, 1 << 63, n - int(n * share), dtype=np.uint64) * np.uint64(2)])
            col = pa.array([minhash.sketch(np.unique(x)) for x in (a, b)], pa.binary())
            got = minhash.alike(minhash.Bins(col, np.array([n, n])), np.array([0]), minhash.Bins(col, np.array([n, n])), np.array([1]), 85)[0]
            assert bool(got) == want or n == 6


def test_missed_agrees_with_a_simulation():
    r = random.Random(1)

    def meets(s, levels):
        return levels == 0 or any(r.random() < s and meets(s, levels - 1) for _ in range(1 + (r.random() < minhash.branching(s) - 1)))

    for levels in (1, 4, 8):
        lost = sum(not meets(0.85, levels) for _ in range(20_000)) / 20_000
        assert lost == pytest.approx(minhash.missed(0.85, levels, 1), abs=0.015)
    assert minhash.missed(0.85, 1, 10) < 1e-9 and minhash.missed(0.85, 12, 10) < 4e-4 and minhash.missed(0.85, 1000, 10) < 2e-3
    first = minhash.first_level(0.85, 10)
    assert len({c for _, c in first}) == len(first) and {t for t, _ in first} == set(range(10))


def test_clashing_columns(spark):
    extra = ["n", "h1", "rep", "_id", "_row", "KEEP", "_text", "component", "known"]
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in extra})
    got = [tuple(r) for r in minhash.near_duplicates(df, Scratch(spark)).collect()]
    assert sorted(got[k][0] or 0 for k in range(6)) == [0, 1, 1, 2, 3, 4]
    left = minhash.deduplicate(df, Scratch(spark))
    assert left.columns == df.columns and sorted((r.doc_id, r[-1]) for r in left.collect()) == [(1, "mine"), (3, "mine"), (4, "mine")]


def test_a_large_cluster_is_compared_in_pairs(spark):
    """A chain of near copies, far from its pivot at the ends, in blocks of a few rows."""
    r = random.Random(8)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[r.randrange(200)] = f"x{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, Scratch(spark), cluster_rows=3).collect()))
    assert got == brute.near_documents(rows, 80)
