"""The field: what it adds by links between distant tokens, and what it is trained on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamworks.llm import pii
from loamworks.llm.common import Scratch, one_text, shared_dir

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet(f"{SF}/documents.parquet"))


def without_links(model):
    out = pii.Model()
    out.u, out.chain, out.skip = model.u, model.chain, np.zeros_like(model.skip)
    return out


PLANTED = [
    ("call bob.smith@x.org now. bob.smith said so", {("email", "bob.smith")}),
    ("a.b9@c.de and, far away, a.b9 then A.B9!", {("email", "a.b9"), ("email", "A.B9")}),
    ("host 97.51.17.173 is down; see 97-51-17-173 in 2024", {("ip", "97-51-17-173")}),
    ("paid with 4929348385146306, not 7777777777777777 4929348385146306", {("card", "4929348385146306")}),
    ("reach +1 (974) 555-3436 or just 555-3436", {("phone", "555-3436")}),
    ("bob.smith said so", set()),
    ("ring 555-3436 or, if nobody is there, 555-3436", set()),
    ("anna@x.org met anna in 2024 and 2024", set()),
    ("order 9807915762804490 and 9807915762804490", set()),
]


@pytest.mark.parametrize("text,want", PLANTED)
def test_links_add_what_patterns_miss(model, text, want):
    said = lambda m: {(pii.KINDS[k], text[s:e]) for k, s, e in pii.find([text], m)[1][0]}
    assert said(model) == want
    assert said(without_links(model)) == set()


def test_precision_of_planted_mentions(spark, model):
    """In the documents that hold an address or number: a second mention of it is found, numbers of the same look are left alone."""
    r, texts, true = random.Random(4), [], []
    for row in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect():
        base = [b for b in pii.base_spans(row.text) if pii.mentions(row.text[b[1] : b[2]], b[0])]
        if not base:
            continue
        k, s, e = base[0]
        way = r.choice(pii.mentions(row.text[s:e], k))
        decoy = "".join(r.choice("123456789") if c.isdigit() else c for c in way)
        texts.append(f"{row.text} so {way} again and {decoy} too")
        true.append((k, len(row.text) + 4, len(row.text) + 4 + len(way)))
    added = pii.find(texts, model)[1]
    hits = sum(t in a for t, a in zip(true, added, strict=True))
    false = sum(x != t and x[1] >= t[1] for t, a in zip(true, added, strict=True) for x in a)
    assert len(texts) >= 20 and hits / len(texts) >= 0.7 and false / max(1, false + hits) <= 0.05


def test_patterns_of_whole_table_stay(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in pii.detect(docs, model).join(docs, "doc_id").collect():
        base = {f"{k}:{s}:{e}" for k, s, e in brute.personal(r.text or "")}
        assert base <= {x for x in r.spans.split(",") if x} and r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_open_nodes():
    text = "bob.smith@x.org then bob.smith then bob.smith; 55512345 55512345"
    g = pii.Graph(text, pii.base_spans(text))
    assert g.open == [False, True, True, False, False] and g.y == [1, 0, 0, 0, 0]
    assert pii.rehearsal(g)[1][:5].tolist() == [1, -1, -1, 0, 0]


def test_one_text_of_a_repeated_id(spark):
    docs = [(i, f"mail u{i}.x@y.org or 4929348385146306 {i}") for i in range(5)]
    once = spark.createDataFrame(docs, "doc_id long, text string")
    often = once.unionByName(spark.range(2000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(docs[3][1]).alias("text"))).withColumn("_id", F.lit("x"))
    one, other = pii.train(once), pii.train(often.repartition(5))
    assert np.array_equal(one.u, other.u) and np.array_equal(one.skip, other.skip) and one.skip.any()


def test_sample_of_bounded_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(10)] + [(99, None)], "doc_id long, text string")
    pick = docs.select(F.col("doc_id").alias("_id"))
    got = one_text(docs, pick, most_bytes=100).collect()
    assert {r._id for r in got} >= {0, 99} and sum(len(r.text or "") for r in got) <= 100
    assert one_text(docs, pick).count() == 11


def test_scratch_is_shared_and_removed(spark):
    with Scratch(spark) as scratch:
        df = scratch.cut(spark.range(5))
        assert df.count() == 5
        fs = spark._jvm.org.apache.hadoop.fs.Path(scratch.root).getFileSystem(spark._jsc.hadoopConfiguration())
        assert fs.exists(spark._jvm.org.apache.hadoop.fs.Path(scratch.root))
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(scratch.root))


class Remote:
    def __init__(self, **conf):
        self.conf = conf


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", ""])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Remote(**{"spark.master": master}))
    assert shared_dir(Remote(**{"spark.master": master, "spark.checkpoint.dir": "s3://b/x"})) == "s3://b/x"


def test_redact(spark, model):
    rows = [(1, "mail bob.smith@x.org, bob.smith", "a"), (1, "mail bob.smith@x.org, bob.smith", "b"), (None, None, "c"), (2, "", "d"), (3, "w " * 50_000 + "bob.smith@x.org", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumns({"model": F.lit(1), "n_ip": F.lit(2)})
    out = pii.redact(df, model).collect()
    assert [r.text for r in out[:4]] == ["mail <EMAIL>, <EMAIL>"] * 2 + [None, ""] and out[4].text.endswith("w <EMAIL>")
    assert [r.spans for r in out] == list("abcde") and pii.redact(df.limit(0), model).count() == 0
