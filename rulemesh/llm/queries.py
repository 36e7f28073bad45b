"""Registered queries of the corpus operators, over their whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemesh.llm import (
    bpe,
    decontaminate,
    fingerprint,
    langid,
    minhash,
    pii,
    ranked,
    secrets,
    spans,
    token_counts,
    token_store,
    toxicity,
    variants,
    warc,
)
from rulemesh.llm.common import fold, table
from rulemesh.session import shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
TOKEN_LIMIT = 512


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the benchmark items it holds, by id, and the greatest similarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.array_max(F.transform("leaks", lambda x: x["similarity"])).alias("similarity"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return indexed.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        "url_key", "captured_at", "position",
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~langid.held_out())
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (fold(F.col("doc_id"), toxicity.HELD_OUT_PARTS) == 0).alias("held_out")
    return toxicity.score(docs, weights).select("doc_id", held_out, "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs).select("doc_id", *spans.digests("personal", pii.BASE))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find(docs).select("doc_id", *spans.digests("secrets", secrets.BASE))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), path, TOKENIZER, END_ID)
    return token_store.summary(spark, path)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded once."""
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, BYTE_TOKENIZER, cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.search(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_fingerprints": op2_fingerprints,
    "op3_web_archive": op3_web_archive,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_personal_data": op8_personal_data,
    "op9_secrets": op9_secrets,
    "op10_token_store": op10_token_store,
    "op11_token_counts": op11_token_counts,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ranked_search": op13_ranked_search,
}

