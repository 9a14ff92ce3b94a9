"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding over documents.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return
the columns of documents. run() writes every stage's result into the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetctx.llm import decontam, langid, mixing, sharding, shared, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that the models reject go. All columns stay as they are.

    Null, empty and letterless texts are rejected; a null lang teaches nothing but its row is judged like others. Where no
    language was learned (no labelled text) no document can be known, and all go. Repeated rows share one fate. An empty
    table stays empty.
    """
    return langid.accepted(docs, langid.train(docs.where(~langid.held_out(F.col("doc_id")))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, fingerprints within 4 bits or sets 0.8 similar.

    The one with the least doc_id stays (ties: the least hash of the text); of its repeated rows one. Null and empty texts
    are one group. A row without doc_id stays only where its whole group has none. An empty table stays empty.
    """
    return simhash.keep_one(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window contaminates; null and empty texts are clean, repeated rows share one fate.

    An empty benchmark contaminates nothing; an empty table stays empty.
    """
    return decontam.remove(docs, shared.benchmark(spark, sf_dir))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents dealt to the target weights; one that several epochs take is repeated.

    A null lang or source is a branch of its own name; texts without words cost nothing and come where their place in the order
    is reached. Rows equal in doc_id, text and branch are taken together. An empty table stays empty.
    """
    return mixing.mix(docs, mixing.tree(), mixing.WEIGHTS, budget_ratio=mixing.BUDGET_RATIO, max_epochs=mixing.MAX_EPOCHS, seed=mixing.SEED)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row that the mix holds.

    Repeated rows lie in one shard with slots of their own; a null doc_id is a key like others, a null text has no bytes.
    """
    return sharding.assign(docs, [1.0] * sharding.SHARDS, grown=[1.0] * (sharding.SHARDS + 1))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Language models and fingerprint components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
