"""Queries that apply the operators of this subpackage to whole tables, and SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import decontam, embed_dedup, fill_middle, html_extract, langid, license_scan, line_dedup, packing, prefix_trie, quality, simhash, token_count, url_filter
from boxloom.sources.tables import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = license_scan.document_files(read_table(spark, sf_dir, "documents"))
    return license_scan.scan(files, F.col("first_line") | F.col("index")).drop("text", "index")


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_html_extract": op3_html_extract,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_license_scan": op7_license_scan,
    "op8_embed_dedup": op8_embed_dedup,
    "op9_langid": op9_langid,
    "op10_url_filter": op10_url_filter,
    "op11_fill_middle": op11_fill_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_count": op13_token_count,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_decontaminate": decontam.ORACLE,
    "op7_license_scan": license_scan.ORACLE,
    "op8_embed_dedup": embed_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
