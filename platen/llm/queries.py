"""The queries of this subpackage: thin calls of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.session import attach, shared_folder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import media

    return media.payload_digests(media.store_payloads(_table(spark, sf_dir, "documents")))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import token_output

    path = shared_folder(spark, "tokens")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), path, end_id=2)
    return token_output.token_digests(spark, path)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import urlfilter

    return urlfilter.verdicts(_table(spark, sf_dir, "pages"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import ann

    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import bpe

    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import neardup

    return neardup.near_duplicate_groups(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import wrapper

    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op8_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import pii

    return pii.report(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platen.llm import packing

    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_avi_media,
            op2_token_output,
            op3_url_rules,
            op4_ann,
            op5_bpe_round_trip,
            op6_minhash_neardup,
            op7_html_wrapper,
            op8_pii_anchors,
            op9_toxicity,
            op10_packing,
        )
    }


def oracle_sql() -> dict[str, str]:
    from platen.llm import neardup, urlfilter

    return {"op3_url_rules": urlfilter.ORACLE, "op6_minhash_neardup": neardup.ORACLE}
