"""Rows without a doc_id, doc_ids with several texts, and stages without labels."""

import corpus_pipeline
import pytest

from loamworks.llm import minhash
from loamworks.llm.common import Scratch

WORDS = [f"w{i}" for i in range(60)]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def near(start, change=None):
    w = [f"{start}{x}" for x in WORDS]
    if change is not None:
        w[0] = change
    return " ".join(w)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", None) for i, t in rows], DOC).repartition(3)


@pytest.mark.parametrize("how", [{}, {"node_rows": 3, "cluster_rows": 1}])
def test_near_copies_without_ids(spark, how):
    rows = [(None, near("a")), (None, near("a")), (None, near("a", "x")), (None, near("b")), (7, near("b", "x")), (9, near("b", "y")), (None, "alone as can be"), (None, None), (None, "")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), Scratch(spark), **how).collect()}
    assert got == {(None, 56, None, None), (None, 56, 7, None), (7, 56, 7, True), (9, 56, 7, False), (None, 1, None, None), (None, 0, None, None)}
    left = [(r.doc_id, r.text) for r in minhash.deduplicate(frame(spark, rows), Scratch(spark), **how).collect()]
    assert len(left) == 5 and sum(t in (near("a"), near("a", "x")) for _, t in left) == 1
    assert {(7, near("b", "x")), (None, "alone as can be"), (None, None), (None, "")} < set(left)


def test_two_texts_of_one_id(spark):
    rows = [(5, near("a")), (5, near("b")), (6, near("a", "x")), (8, near("b", "x")), (2, near("c")), (5, near("c", "x"))]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), Scratch(spark)).collect()}
    assert got == {(5, 5, True), (6, 5, False), (8, 5, False), (2, 2, True), (5, 2, False)}
    left = {(r.doc_id, r.text) for r in minhash.deduplicate(frame(spark, rows), Scratch(spark)).collect()}
    assert left == {(5, near("a")), (5, near("b")), (2, near("c"))}


@pytest.mark.parametrize("labels", [[], [(2, 1)], [(0, None)]])  # doc_id 2 has no text here
def test_no_labels_keep_all(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [(0, "a clean text"), (1, None), (None, "another")])
    with pytest.warns(UserWarning, match="every document is kept"):
        assert corpus_pipeline.toxic(spark, docs, str(tmp_path)).count() == 3
