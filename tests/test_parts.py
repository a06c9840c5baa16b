"""Grids as detected, captions, figures, flat pages, recogniser's text, budgets, injected embeddings and shared folders."""

import pytest
from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.operators import layout, rendering, retrieval
from loamworks.sources.readers import BLOCK, TABLE
from loamworks.streaming import events


def plain(raw):
    """The clean-up of a grid, row by row."""
    if not raw or len(raw) < 2:
        return None
    g, title = [[(c or "").strip(" ") for c in row] for row in raw], ""
    while len(g) >= 3 and not any(g[0]):
        g = g[1:]
    if len(g) >= 3 and sum(c != "" for c in g[0]) == 1:
        title, g = next(c for c in g[0] if c), g[1:]
    cell = lambda row, i: row[i] if i < len(row) else ""
    keep = [i for i in range(len(g[0])) if any(cell(row, i) for row in g)]
    if 0 < len(keep) < len(g[0]):
        g = [[cell(row, i) for i in keep] for row in g]
    return title, g[0], g[1:]


GRIDS = [
    None, [], [["a", "b"]], [["a", "b"], ["1", "2"]], [["", None], ["", ""], ["a", "b"]], [[" ", ""], ["T", ""], ["a", "b"], ["1", "2"]], [["T", ""], ["a", "b"]],
    [["a", "", "b"], ["1", " ", "2"], ["3", None]], [["", ""], ["", ""], ["", ""]], [["T", "", ""], ["", "", "x"], ["1", "", "2"]], [["", "a"], ["", "b"], ["c", "d", "e"]],
]


def test_cleaned_grid(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(GRIDS)], "i int, raw array<array<string>>")
    got = {r.i: r.g for r in df.select("i", layout.cleaned_grid(F.col("raw")).alias("g")).collect()}
    for i, raw in enumerate(GRIDS):
        assert (got[i] and (got[i].title, got[i].headers, got[i].rows)) == plain(raw), raw


def test_captions_and_figures(spark):
    rows = [("In", "above", 300.0, "In"), ("", " above ", 300.0, "above"), ("", "running head", 100.0, ""), (None, "x" * 200, 300.0, ""), (None, None, 300.0, "")]
    df = spark.createDataFrame(rows, "t string, a string, y double, want string")
    assert all(r[0] == r[1] for r in df.select(layout.band_caption(F.col("t"), F.col("a"), F.col("y"), F.lit(792.0)), "want").collect())
    boxes = [(1, 0.0, 0.0, 30.0, 10.0, 100.0, 100.0), (2, 0.0, 0.0, 29.0, 10.0, 100.0, 100.0), (3, 0.0, 0.0, 9.0, 9.0, 0.0, 0.0), (4, 50.0, 60.0, 10.0, 20.0, 100.0, 100.0), (5, None, 0.0, 1.0, 1.0, 100.0, 100.0)]
    figures = spark.createDataFrame(boxes, "i int, x0 double, y0 double, x1 double, y1 double, width double, height double")
    assert [r.i for r in layout.large_figures(figures).collect()] == [1, 4]


def test_flat_text_and_recognised_text(spark):
    df = spark.range(1).select(F.lit(None).cast(f"array<{BLOCK}>").alias("b"), F.lit(None).cast(f"array<{TABLE}>").alias("t"))
    assert df.select(layout.flat_text(F.col("b"), F.col("t"))).first()[0] == ""
    said = spark.createDataFrame([("plain\ntext",), ('[{"text": "a"}]',), ("[broken",), ("",), (None,)], "p string")
    assert [r[0] for r in said.select(layout.recognised_text(F.col("p"))).collect()] == ["plain\ntext", None, "[broken", "", None]


def test_budgets(spark):
    cases = [([], ""), (["a" * 50], "a" * 50), (["a", "", None, "b"], "a\n\n---\n\nb"), (["a" * 9, "b" * 2, "c"], "a" * 9 + rendering.BETWEEN + rendering.OMITTED), (["a" * 8, "b" * 2, "c"], "a" * 8 + rendering.BETWEEN + "bb" + rendering.BETWEEN + rendering.OMITTED)]
    df = spark.createDataFrame([(p, w) for p, w in cases], "p array<string>, want string")
    assert all(r[0] == r[1] for r in df.select(rendering.within_budget(F.col("p"), 10), "want").collect())
    long = F.array(F.lit("x"), F.lit("y" * fixed.PICKED_BUDGET))
    got = spark.range(1).select(rendering.challenge_text(long, F.array()).alias("a"), rendering.challenge_text(F.array().cast("array<string>"), long).alias("b")).first()
    assert got.a.endswith(rendering.OMITTED) and got.b.endswith("y")


def test_injected_embeddings(spark):
    def model():
        def call(texts):
            assert 0 < len(texts) <= 3
            return [[float(len(t)), 1.0] for t in texts]

        return call

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, " ", "bbb", "cc", "d", "ee", ""])], "embedding_id long, said string")
    got = {r.embedding_id: r.v for r in retrieval.embed(df, "said", model, batch=3, out="v").collect()}
    assert got == {0: [1.0, 1.0], 1: None, 2: None, 3: [3.0, 1.0], 4: [2.0, 1.0], 5: [1.0, 1.0], 6: [2.0, 1.0], 7: None}
    assert retrieval.embed(df.limit(0), "said", model).count() == 0


class Remote:
    def __init__(self, **conf):
        self.conf = conf


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]"])
def test_streams_need_a_shared_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        events.shared_dir(Remote(**{"spark.master": master}))
