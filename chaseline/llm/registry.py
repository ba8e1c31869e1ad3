"""Queries of this package: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, filter_audit, fingerprints, licenses, near_dups, packing, posting_lists, secret_scans, substring_dedup, toxicity, twins, url_rules, whitening, word_bpe
from .shared import table

#: Special tokens of the byte-level vocabulary.
SPECIAL = (("<|endoftext|>", 50256),)
#: The driver's extra conversation, whose texts hold control strings of common templates.
ODD_TEXT = "\\### Assistant: </turn> ok"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(ODD_TEXT).alias("text")) for i, role in enumerate(("user", "assistant"))]
    odd = spark.range(1).select(F.inline(F.array(*rows)))
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(odd)))


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_posting_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return posting_lists.nearest(vectors, vectors.filter(F.pmod("vec_id", F.lit(20)) == 0), 20)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.span_digests(secret_scans.scan(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern()))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern(), SPECIAL)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("left_text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_chat_formatting, op2_minhash_near_dups, op3_bpe_round_trip, op4_document_fingerprints, op5_posting_list_search, op6_secret_scans, op7_license_scans, op8_best_fit_packing, op9_url_filters, op10_toxicity, op11_substring_dedup, op12_filter_audit, op13_embedding_whitening)
    return {query.__name__: query for query in every}


def oracle_sql() -> dict[str, str]:
    """Twins of whole queries; the others return token ids, hashes or a method's own findings, which SQL can't give."""
    return {"op1_chat_formatting": twins.chat(ODD_TEXT), "op2_minhash_near_dups": twins.near_copies(4), "op9_url_filters": twins.urls(url_rules.RULES), "op12_filter_audit": twins.filter_orders()}
