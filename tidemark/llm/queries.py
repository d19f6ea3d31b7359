"""The registered queries opN_<name> and ``pipeline``."""

from __future__ import annotations

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import alignment, chunk_dedup, conversations, language, lm_score, secret_scan, sentencepieces, suffix_dedup, toxicity
from tidemark.llm.common import fold, load
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.fingerprints import edited_fingerprints
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.packing import pack
from tidemark.registry import QueryFn
from tidemark.session import freeze

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    got = jaccard_components(load(spark, sf, "documents"))
    return got.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "class_id", "search_links")


def _ids_crc32(ids: pd.Series) -> pd.Series:
    import zlib

    return ids.map(lambda b: zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes()))


@query
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = pack(load(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.pandas_udf(_ids_crc32, "long")("ids")).drop("ids")


@query
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return edited_fingerprints(load(spark, sf, "documents"))


@query
def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", "lang"))
    return language.predict(docs, model, ["doc_id", held_out.alias("held_out")])


@query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model, ["doc_id", held_out.alias("held_out")])


@query
def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


@query
def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    _, found = secret_scan.findings(load(spark, sf, "documents"))
    return secret_scan.judged(found, secret_scan.train(found))


@query
def op2_chunk_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = chunk_dedup.deduplicated(load(spark, sf, "documents"))
    return got.withColumns({"n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)}).drop("kept")


@query
def op9_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = suffix_dedup.deduplicated(load(spark, sf, "documents"))
    return got.withColumns({"n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)}).drop("kept", "spans")


@query
def op1_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    counts = freeze(lm_score.word_counts(docs))
    return lm_score.word_scores(docs, lm_score.fit(docs.select(F.col("doc_id").alias("id"), "text"), counts=counts), counts)


@query
def op13_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepieces.encode(load(spark, sf, "documents"), path, ["doc_id"])
    digests = ["doc_id", F.size("ids").cast("long").alias("n_tokens"),
               F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")]
    got = sentencepieces.decode(coded, path, [*digests])
    return got.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations")
    return conversations.repair_report(conversations.damaged(rows), rows)


@query
def op11_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(load(spark, sf, "documents"), a, b, ["doc_id"])[0]
