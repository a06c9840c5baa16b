"""The pipeline's stages on small tables, each against what its operator says."""

import corpus_pipeline
from loamworks.llm import toxicity
from loamworks.llm.common import table

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "pii", "mixing", "packing"]
    clean = stages["toxicity"](spark, docs, SF)
    said = toxicity.toxicity(docs, table(spark, SF, "labels"))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in said.where("predicted = 0").collect()}
    once = stages["minhash near-dedup"](spark, clean, SF)
    want = {i for i, _, _, kept in brute.near_documents([(r.doc_id, r.text) for r in clean.collect()], 80) if kept}
    assert {r.doc_id for r in once.collect()} == want
    masked = stages["pii"](spark, once, SF)
    assert masked.columns == docs.columns and masked.count() == len(want)
    for r in masked.collect():
        assert not brute.personal(r.text) and r.n_chars == len(r.text)
    mixed = stages["mixing"](spark, masked, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= want
    packed = stages["packing"](spark, mixed, SF)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
