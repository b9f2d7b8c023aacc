"""The queries of this subpackage: one thin ``opN_<name>`` for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .collocations import mine_collocations
from .common import read_table
from .exact_dedup import exact_dedup
from .lexical import rank_documents
from .line_dedup import dedup_lines
from .mixing import mix
from .neighbours import nearest
from .oracles import ORACLE_SQL
from .packing import harmonic_pack
from .quality import score_quality
from .secrets import secrets_digest
from .sharding import shard_by_slots
from .simhash import near_duplicates
from .token_files import read_token_files, write_token_files
from .toxicity import score_toxicity


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate", "source")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"),
        F.concat_ws(",", F.col("deleted").cast("array<string>")).alias("deleted"), F.sha2("text", 256).alias("text_sha256"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_token_files(manifest)


def op6_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), query_step=20, k=20)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(read_table(spark, sf_dir, "documents"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_slots(read_table(spark, sf_dir, "documents"), shards=40)


def op11_phrase_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(read_table(spark, sf_dir, "documents"))


def op12_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_entropy_balance": op1_entropy_balance,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_line_winnowing": op4_line_winnowing,
    "op5_token_files": op5_token_files,
    "op6_cuckoo_dedup": op6_cuckoo_dedup,
    "op7_multi_index_hashing": op7_multi_index_hashing,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_entropy_secrets": op9_entropy_secrets,
    "op10_virtual_slots": op10_virtual_slots,
    "op11_phrase_hashing": op11_phrase_hashing,
    "op12_random_indexing": op12_random_indexing,
    "op13_bit_sliced": op13_bit_sliced,
}

__all__ = ["ORACLE_SQL", "QUERIES", "vocabulary"]
