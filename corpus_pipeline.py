"""The corpus pipeline: toxic documents go, near duplicates go, personal data is masked, sources are mixed, and the mix is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.llm import minhash, mixing, packing, pii, toxicity
from loamworks.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


# Every stage but the last returns the columns of documents, and leaves others out. Null doc_ids, sources and texts,
# empty and very long texts, repeated rows and empty tables are what its operator says of them.


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that the classifier does not call toxic; each row by itself, whole texts. Without labels to learn from: all."""
    return toxicity.reject(docs, toxicity.model(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id. Texts without words: all of them."""
    return minhash.deduplicate(docs, scratch or Scratch(spark)).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """All documents, with personal data masked and n_chars counted anew. Null text: null, and null n_chars."""
    return _measured(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The documents in training order, each as often as the mix reads it. Texts without words are never read."""
    return _measured(mixing.curriculum(docs, scratch or Scratch(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The pieces of the packed sequences, whose ids rise with the training order that the mix wrote."""
    return packing.pack(docs, in_order=True)


STAGES = [("toxicity", toxic), ("minhash near-dedup", near_duplicates), ("pii", personal_data), ("mixing", mix), ("packing", pack)]

#: Trained models and hashed orders are not expressible in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written as Parquet and read again, and what it was made from is removed."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as own:
            done = scratch.cut(stage(spark, docs, sf_dir, own), name.split()[0])
        scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
