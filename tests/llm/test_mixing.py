"""Copies, clashing columns and positions of the mix, against a plain version."""

import math

import pytest
from pyspark.sql import functions as F

from loamworks.llm import mixing
from loamworks.llm.common import Scratch

from . import brute
from .test_operators import DOC, prose

ROWS = [(i, prose(10 + i % 40, i)) for i in range(80)] + [(7, prose(17, 7))] * 30 + [(200, prose(50, 999))] * 9 + [(None, prose(12, 5))] * 4 + [(300, None), (301, ""), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i is None or i % 5 == 0 else f"s{i % 3}", None) for i, t in rows], DOC).repartition(3)


def when(u, a):
    """The inverse of t + a (t^2 - t) by bisection."""
    low, high = 0.0, 1.0
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if t + a * (t * t - t) < u else (low, t)
    return low


def test_positions_and_copies(spark):
    got = mixing.mix(frame(spark, ROWS), Scratch(spark), per_bucket=2).collect()
    assert len(got) == len(ROWS)
    sizes, by = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        by.setdefault(r.source, []).append(r)
    want = brute.targets(sizes, mixing.WEIGHTS, 1.5, 2.0)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, rows in by.items():
        rows = sorted((r for r in rows if r.size), key=lambda r: r.source_offset)
        at, slope = 0, mixing.SLOPES[order.index(s) % 3]
        rounds, left = divmod(want[s], sizes[s])
        for r in rows:  # one place after another, copies included
            assert r.source_offset == at and r.rank == order.index(s)
            assert r.taken == rounds * r.size + max(0, min(r.size, math.floor(left + 1e-6) - at))
            assert r.position == (None if r.taken == 0 else pytest.approx(when(min(1.0, at / want[s]), slope), abs=1e-9))
            at += r.size
        assert abs(sum(r.taken for r in rows) - want[s]) <= 1
    copies = [r for r in got if r.doc_id == 7 and r.size == 17]
    assert len(copies) == 31 and len({r.source_offset for r in copies}) == 31


@pytest.mark.parametrize("chunk", [4, 4096])
def test_copies_in_chunks(spark, chunk):
    planned = spark.createDataFrame([(1, 5, 3, 11, 100, 150.0, 20), (2, 6, 0, 1, 100, 150.0, 0)], "doc_id long, text_hash long, size long, copies long, source_size long, target double, at long")
    got = sorted((r.doc_id, r.copy, r.at, r.taken) for r in mixing.each_copy(planned, chunk).collect())
    assert got == [(1, k, 20 + 3 * k, 3 + max(0, min(3, 50 - 20 - 3 * k))) for k in range(11)] + [(2, 0, 0, 0)]


def test_curriculum_with_clashing_columns(spark):
    ours, extra = ["position", "words", "PASS"], ["_size", "_p", "_row", "copy", "size", "taken", "_text", "at", "key", "_s"]
    df = frame(spark, ROWS).withColumns({c: F.lit("mine") for c in ours + extra})
    run = mixing.curriculum(df, Scratch(spark))
    assert run.columns == [c for c in df.columns if c not in ours] + ["position", "pass", "words"]
    rows = run.collect()
    assert all(r[c] == "mine" for r in rows for c in extra)
    assert all(len(brute.WORD.findall(r.text)) == r.words for r in rows)


def test_curriculum_reads_no_more_than_the_mix(spark):
    df = frame(spark, ROWS)
    taken = mixing.mix(df, Scratch(spark)).groupBy("doc_id", "text_hash").agg(F.sum("taken").alias("n")).where("n > 0")
    run = mixing.curriculum(df, Scratch(spark))
    read = {(r.doc_id, r.source): r.n for r in run.groupBy("doc_id", "source").agg(F.sum("words").alias("n")).collect()}
    assert sum(read.values()) == taken.agg(F.sum("n")).first()[0]
    position = [r.position for r in run.collect()]
    assert position == sorted(position) and 0 <= position[0] and position[-1] <= 1
    assert mixing.curriculum(df.limit(0), Scratch(spark)).count() == 0


def test_texts_that_are_read_whole_stay_out_of_python(spark, monkeypatch):
    cut = mixing._cut

    def only_parts(batches):
        for b in batches:
            words, size = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("words", "size"))
            assert all(w < n for w, n in zip(words, size, strict=True)), "a text that is read whole"
            yield from cut([b])

    monkeypatch.setattr(mixing, "_cut", only_parts)
    rows = mixing.curriculum(frame(spark, ROWS), Scratch(spark)).collect()
    whole = {(r.doc_id, r.source, r.text) for r in frame(spark, ROWS).collect()}
    assert any((r.doc_id, r.source, r.text) not in whole for r in rows)
    assert all(len(brute.WORD.findall(r.text)) == r.words for r in rows)
