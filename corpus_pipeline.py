"""A corpus pipeline of four stages over documents: toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents, and each result is written as Parquet and read again for the next.

Defined cases, in every stage: a null doc_id or a null in another column is kept as it is; an empty table
gives an empty table; long texts are read whole; further columns pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platen.llm import neardup, packing, pii, toxicity
from platen.llm.queries import tokenizer_path
from platen.session import attach, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model rejects go; it learns from the labels of the documents that arrive.

    Null and empty texts have no matches and stay; so does every row if no labels of both kinds are there.
    Repeated rows have equal scores: they go or stay together. A score of exactly 0.5 rejects.
    """
    attach(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id: five words, a similarity of 0.8.

    Rows that repeat doc_id and words leave one, the least by its JSON form; rows that share a doc_id only are judged each by
    its own text. Texts without words and rows without a doc_id are nobody's copies and stay, each row of them.
    """
    attach(spark)
    return neardup.without_near_duplicates(docs, shingle=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become placeholders; n_chars follows.

    Null texts stay null, empty ones empty; repeated rows give repeated rows.
    """
    attach(spark)
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens.

    A null or empty text is a document of its end id; each of several rows of one doc_id is packed for itself.
    """
    attach(spark)
    return packing.pack_documents(docs, tokenizer_path(), end_id=0)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data), ("packing", pack_sequences)]

#: The stages are no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
