"""The corpus pipeline: toxic documents go, of exact and near copies one document stays, documents with benchmark
passages go, and the rest is encoded. All stages but the last return the columns of documents; each works on all rows
that the stage before it kept. Clean documents are never dropped."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaxis.llm import decontaminate, exact_dedup, jaccard_join, toxicity
from tessaxis.llm.common import crc_mod, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of the other fifths, scores under 0.5."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    free = max(docs.columns, key=len) + "_score"
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out=free)
    return scored.where(F.col(free) < 0.5).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows that gone names by doc_id and text_hash; other rows of these ids stay."""
    named = written(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    return docs.join(named, docs["doc_id"].eqNullSafe(named["_id"]) & (F.xxhash64(docs["text"]) == named["_hash"]), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component; of one without any doc_id all stay."""
    labels = jaccard_join.near_duplicates(docs)
    return _without(docs, labels.where("NOT doc_id <=> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of token ids and digests of the ids and of the decoded bytes."""
    from tessaxis.llm.queries import bpe_digests

    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe_codec", encode),
]

#: The toxicity model and the encoder have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
