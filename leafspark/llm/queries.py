"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .decontaminate import decontaminate
from .extract import extract_pages
from .licenses import scan_licenses
from .lm_score import score_corpus
from .media import media_features
from .ngram_join import ngram_join
from .oracles import ORACLES as ORACLES
from .toxicity import classify
from .url_filter import judge_urls
from .warc import archive_pages


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more, and each
    document's number of links."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100, links=True)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in ten-word windows of the benchmark."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, by a classifier trained on labelled ones."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents under the public word BPE, and their decoding."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence detections in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as lossless WebP, read back."""
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents under the trigram counts of all others."""
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=3)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op6_bpe_encoding": op6_bpe_encoding,
    "op5_license_scan": op5_license_scan,
    "op9_media_columns": op9_media_columns,
    "op3_lm_scoring": op3_lm_scoring,
    "op1_html_extraction": op1_html_extraction,
    "op2_url_filter": op2_url_filter,
    "op10_warc_records": op10_warc_records,
}
