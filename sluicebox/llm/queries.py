"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm import (
    decontaminate,
    gru,
    linededup,
    oracles,
    prefixtrie,
    quality,
    secretscan,
    sentencepiece,
    simhash,
    tokencount,
    tokenfile,
    toxicity,
    vectorcode,
    warc,
)
from sluicebox.llm.common import remainder_of_crc32, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": oracles.PREFIX_TRIE,
    "op13_vector_codes": oracles.VECTOR_CODES,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.encode_documents(table(spark, sf_dir, "documents"), path, keep_ids=False)


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, end_id=1)
    return tokenfile.read_token_files(manifest, keep_ids=False)


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0), keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_verdict(docs, drop_text=True).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept", "quality"
    )


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))

    def of(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(secretscan.joined_spans("base"), 256).alias("base_sha256"),
        secretscan.joined_spans("spans").alias("spans"),
    )


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = simhash.with_fingerprint(table(spark, sf_dir, "documents"), words_per_shingle=4)
    return simhash.cluster(marks, distance=4).withColumn("fingerprint", simhash.hex_text(F.col("fingerprint")))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"), short_equal=True)


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items, short_inside=True)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), hold_out=2)
    scored = toxicity.score_documents(docs, model, with_spans=False)
    return scored.select(
        "doc_id",
        (remainder_of_crc32("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.PREDICTED).cast("int").alias("predicted"),
    )


@query
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score_documents(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie_nodes(table(spark, sf_dir, "conversations"))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), path)


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.code_report(table(spark, sf_dir, "embeddings"))
