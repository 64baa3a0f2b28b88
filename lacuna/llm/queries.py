"""The dealt operators as registered queries: ``(spark, folder) -> DataFrame``."""

from pyspark.sql import functions as F

from .decontaminate import contamination
from .filter_audit import audit_filters
from .hard_negatives import hard_negatives
from .mixing import copies, mixture
from .order_minhash import near_duplicate_classes
from .pages import extract_text
from .langid import language_table
from .licenses import scan_licenses
from .projection_forest import vector_links
from .repeats import repeated_bytes
from .sharding import shard_records
from .substrings import repeated_spans
from .text import table
from .token_counts import count_tokens, read_vocabulary

SHARDS = 40
#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"


def op1_substring_dedup(spark, folder):
    # Passages of over 50 words: with its gap a word takes three bytes or more. Single common lines are shorter.
    return repeated_spans(table(spark, folder, "documents"), passage=150)


def op2_minhash_near_dedup(spark, folder):
    found = near_duplicate_classes(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), F.lower(F.hex("root")).alias("class_root"))


def op3_language_id(spark, folder):
    return language_table(table(spark, folder, "documents"))


def op4_sharding(spark, folder):
    placed = shard_records(table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op5_decontamination(spark, folder):
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_license_scan(spark, folder):
    return scan_licenses(table(spark, folder, "documents"))


def op7_token_counts(spark, folder, vocabulary=f"{TOKENIZERS}/{VOCABULARY}"):
    return count_tokens(table(spark, folder, "documents"), read_vocabulary(vocabulary))


def op8_source_mixing(spark, folder):
    found = mixture(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("text_hash"))).drop("text_hash")


def op9_html_extraction(spark, folder):
    return extract_text(table(spark, folder, "pages"))


def op10_embedding_near_dedup(spark, folder):
    return vector_links(table(spark, folder, "embeddings"))


def op11_hard_negatives(spark, folder):
    return hard_negatives(table(spark, folder, "embeddings"))


def op12_suffix_array_dedup(spark, folder):
    found = repeated_bytes(table(spark, folder, "documents"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_filter_audit(spark, folder):
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


def queries():
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_language_id": op3_language_id,
        "op4_sharding": op4_sharding,
        "op5_decontamination": op5_decontamination,
        "op6_license_scan": op6_license_scan,
        "op7_token_counts": op7_token_counts,
        "op8_source_mixing": op8_source_mixing,
        "op9_html_extraction": op9_html_extraction,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_suffix_array_dedup": op12_suffix_array_dedup,
        "op13_filter_audit": op13_filter_audit,
    }
