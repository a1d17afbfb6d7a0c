"""The operators of this package as queries over the given tables. Those that SQL can express are in `oracles`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from filecensus.llm import byte_bpe, conversations, decontaminate, embedding_dedup, jaccard_join, packing, pii, quality, sharding, suffix_dedup, token_counts, token_files, whitening
from filecensus.operators.scale import cut_lineage, new_table


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_transducer_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, folder, "documents"), shards=8)


def op6_segment_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _read(spark, folder, "documents")
    return docs.select(
        "doc_id", byte_bpe.digests(F.col("text"), path, public_tokenizers.PATTERN).alias("found")
    ).select("doc_id", "found.*")


def op8_prefix_doubling_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_read(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    table = new_table(spark)
    token_files.write(_read(spark, folder, "documents"), table, public_tokenizers.path("byte_bpe_50k.json"),
                      public_tokenizers.PATTERN)
    read = token_files.read_tokens(spark, table)
    return read.select("doc_id", "start", "n_tokens", token_files.ids_crc32(F.col("ids")).alias("ids_crc32"))


def op10_winnowing_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.drop("row_key")


def op3_pivot_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, folder, "embeddings"))


def op4_minhash_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, folder, "documents"))


def op5_semi_markov_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(_read(spark, folder, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}")
              for kind in pii.KINDS]
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("bigint").alias("n_added")
    return found.select(
        "doc_id", *counts, F.sha2(pii.shown(base).cast("binary"), 256).alias("base_sha256"),
        pii.shown(F.col("spans")).alias("spans"), added)


def op7_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op11_run_length_repair(spark: SparkSession, folder: str) -> DataFrame:
    table = _read(spark, folder, "conversations")
    turns = conversations.damage(table)
    edited = conversations.edits(turns)
    digests = conversations.digests(conversations.repaired(edited, turns)).withColumnRenamed("conv_id", "conv")
    counted = conversations.audits(edited, table)
    joined = counted.join(digests, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)))


def op12_block_matrix_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_read(spark, folder, "embeddings"))


def op13_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut_pieces(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.PATTERN)
    # Checksums are taken where the ids stand; only places are moved.
    summed = pieces.select("row", "doc_id", "piece", "start", "length",
                           token_files.ids_crc32(F.col("ids")).alias("ids_crc32"))
    return summed.join(cut_lineage(packing.pack(pieces)), "row").drop("row")


QUERIES = {
    "op1_transducer_token_counts": op1_transducer_token_counts,
    "op2_hash_tree_shards": op2_hash_tree_shards,
    "op3_pivot_near_vectors": op3_pivot_near_vectors,
    "op4_minhash_jaccard_join": op4_minhash_jaccard_join,
    "op5_semi_markov_pii": op5_semi_markov_pii,
    "op6_segment_tree_bpe": op6_segment_tree_bpe,
    "op7_weak_label_quality": op7_weak_label_quality,
    "op8_prefix_doubling_dedup": op8_prefix_doubling_dedup,
    "op9_token_files": op9_token_files,
    "op10_winnowing_decontamination": op10_winnowing_decontamination,
    "op11_run_length_repair": op11_run_length_repair,
    "op12_block_matrix_whitening": op12_block_matrix_whitening,
    "op13_sum_of_squares_packing": op13_sum_of_squares_packing,
}
