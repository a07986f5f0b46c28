"""The operators' queries over the driver tables: each reads its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.ann import nearest
from sessionloom.llm.common import scratch_path, table
from sessionloom.llm.divergence import source_divergence
from sessionloom.llm.jaccard_join import jaccard_components
from sessionloom.llm.line_dedup import line_dedup
from sessionloom.llm.packing import pack_documents
from sessionloom.llm.pieces import piece_digests
from sessionloom.llm.prefix_trie import prefix_trie
from sessionloom.llm.quality_classifier import score_quality
from sessionloom.llm.quality_rules import quality_rules
from sessionloom.llm.records import build_index, write_records
from sessionloom.llm.secret_scan import scan_digest, secret_scan
from sessionloom.llm.substring_dedup import substring_dedup
from sessionloom.llm.suffix_dedup import suffix_dedup


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted).select(*names)


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    write_records(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), path, end_id=2)
    return build_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_digest(secret_scan(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_approximate_nearest_neighbours": op3_approximate_nearest_neighbours,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_records": op10_token_records,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_secret_scan": op13_secret_scan,
}
