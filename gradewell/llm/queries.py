"""The registered queries of the text operators: thin projections of each operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html, licenses, packing, quality, repetition, sentencepieces, simhash, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary."""
    out = tokens.token_counts(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", room=2048, end_id=0)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every query row by inner product."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.TEMPLATES, least=0.8)


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's segmentation with merge-dropout, and whether it decodes to the text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    ids = sentencepieces.encode(docs, "piece_bpe_32k.model", dropout=0.1, seed=1, keep=("n_bytes", "text_hash"))
    ids = ids.withColumn("n_pieces", F.size("ids").cast("long")).withColumn("ids_hash", F.xxhash64("ids"))
    back = sentencepieces.decode(ids, "piece_bpe_32k.model")
    return back.select("doc_id", "n_bytes", "n_pieces", "ids_hash", (F.xxhash64("text") == F.col("text_hash")).alias("lossless"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on repetition of every document."""
    out = repetition.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_covered", "longest_repeat")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html.extract(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash class of every document."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_merge_dropout": op6_merge_dropout,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op5_license_scan": licenses.oracle(licenses.TEMPLATES, 0.8),
}
