"""One query per operator of this subpackage, with its production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataroute.llm import bpe, hard_negatives, language_id, max_sketch, packing, topk, toxicity
from dataroute.llm.exact_dedup import copy_groups
from dataroute.llm.jaccard_join import near_duplicates
from dataroute.llm.minhash import near_copies
from dataroute.llm.secrets import find_secrets
from dataroute.llm.suffix_dedup import remove_repeated_strings
from dataroute.llm.substring_dedup import remove_repeated_passages


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several equal texts stays."""
    return copy_groups(_documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are left without strings of 100 bytes that start earlier too."""
    return remove_repeated_strings(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 85 per cent of their 4-word shingles, as components."""
    return near_duplicates(_documents(spark, sf_dir), words=4, percent=85)


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids of every text and their decoding, as digests."""
    definition = bpe.read_definition(path or public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_documents(_documents(spark, sf_dir), definition).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; every text with a letter gets a learnt one."""
    docs = _documents(spark, sf_dir)
    model = language_id.fit(docs)
    return language_id.predict(docs, model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's place in sequences of 2048 tokens."""
    definition = packing.read_definition(path or public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(_documents(spark, sf_dir), definition).drop("ids")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest integer inner product for every 20th vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors, F.col("vec_id") % 20 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text, and where its toxic words are."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", "spans")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text and a digest of those that the fixed patterns find."""
    return find_secrets(_documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are left without passages of 13 words that an earlier document has."""
    return remove_repeated_passages(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item, by the weights of its terms."""
    return max_sketch.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score below the positives of every 100th vector, but not far."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 80 per cent of their 4-word shingles; one of each component is kept."""
    return near_copies(_documents(spark, sf_dir), words=4, percent=80)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_bpe": op4_bpe,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_topk_search": op7_topk_search,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_minhash_dedup": op13_minhash_dedup,
}
