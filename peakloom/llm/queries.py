"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate
from .common import new_path, table
from .langid import identify
from .licences import licences
from .lzprint import fingerprint
from .mixing import mix
from .ngramjoin import jaccard_components
from .oracles import oracle_sql  # noqa: F401
from .ranked import search
from .secrets import secrets
from .sharding import shard
from .spelling import variants
from .suffixdedup import PASSAGE, without_repeats
from .tokencount import document_tokens
from .warc import read_archives, revisits, write_archives


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    archived = read_archives(write_archives(revisits(pages), new_path(spark, "warc")))
    return archived.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand as files of their sources' trees; every eighth is a licence file, some of them a directory higher."""
    n = F.col("doc_id")
    name = F.when(n % 8 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), n, F.lit(".txt")))
    leaf = F.when(n % 64 != 0, F.floor(n / 64))
    path = F.concat_ws("/", "source", F.floor(n / 512), leaf, name)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licences(files, carry=("doc_id",)).select("doc_id", "path", "own_licence", F.round("similarity", 6).alias("similarity"), "licence", "licence_dir")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "next_map_shard",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_shared, the bytes in repeats of 256 bytes and more, finds passages of some 50 words, which mostly are shorter than the 400 bytes that are removed."""
    return without_repeats(table(spark, sf_dir, "documents"), passage=PASSAGE)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc_dictionary, op2_decontaminate, op3_lz_fingerprint, op4_licences, op5_token_counts, op6_virtual_slots, op7_language_id, op8_suffix_dedup, op9_ngram_jaccard, op10_mix_sources,
        op11_spelling_variants, op12_ranked_search, op13_secret_scan,
    )
    return {f.__name__: f for f in found}
