"""The corpus pipeline: documents through toxicity, near-duplicates, benchmark decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return
documents' columns, whatever further ones there are and however they are named. Toxicity and decontamination decide on
every row by its own text, in the pass that reads it; near-duplicates go by id, so rows that share an id share its
decision and rows with a null id stay. Null and empty texts are neither toxic nor contaminated nor duplicates; they are
packed as their end id. An empty table gives no rows. Stage tables stay in the shared folder, as the result reads the
last one; tessera.llm.store.discard(spark) removes them once it is saved. Every stage bounds the Arrow batches of the
session to a few megabytes, unless the session bounds them itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import toxicity
from tessera.llm.decontaminate import decontaminated
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import packed
from tessera.llm.store import bounded_batches, keyed_to, stored
from tessera.llm.tokens import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled ones among them, rejects go."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates (a similarity of 0.8 or more) stays."""
    bounded_batches(spark)
    gone = stored(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "duplicates")
    return keyed_to(docs, gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded_batches(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packed(docs, vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]
#: No SQL: a fitted model and a tokenizer decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
