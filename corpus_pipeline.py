"""A corpus pipeline: toxic documents go, one document of each class of near copies stays, benchmark passages go, and
what is left is encoded.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), where docs is its predecessor's result as
written and read again, and sf_dir has the other tables. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm.bpe import round_trip
from leafspark.llm.decontaminate import find_benchmark
from leafspark.llm.ngram_join import by_key, ngram_join, row_key
from leafspark.llm.scratch import Scratch
from leafspark.llm.toxicity import fit, score

#: The stages use trained models, hashes of ids and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier scores below its threshold; it is trained on the labelled rows of docs. A null or
    empty text is scored as one without words; repeated rows and rows without id are judged alike; of no rows none stay."""
    model = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    kept = docs.withColumn("_toxicity", score(F.col("text"), model))
    return kept.where(F.col("_toxicity.predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a similarity of 0.8 or more of their sets of five-word shingles one row, that
    with the smallest doc_id (one without id only if none has any). Rows without words all stay."""
    found = ngram_join(docs, n=5, num=80, den=100, rows=True).where("n_shingles > 0")
    first = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("first")).select("first.key")
    with Scratch(spark) as scratch:
        first = scratch.write(first)
        gone = scratch.write(found.select("key").distinct().join(first, "key", "left_anti").withColumnRenamed("key", "_key"), keep=True)
        # Rows that repeat both id and text share a key.
        repeated = scratch.write(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").join(first, "key", "left_semi").select(F.col("key").alias("_key")), keep=True)
        kept = by_key(docs.withColumn("_key", row_key()), gone, gone.count(), "_key", "left_anti")
        if many := repeated.count():
            once, twice = (by_key(kept, repeated, many, "_key", how) for how in ("left_anti", "left_semi"))
            kept = once.unionByName(twice.dropDuplicates(["_key"]))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of ten words of a benchmark item occurs. Null and empty texts have no words and stay, as
    repeated rows do; with an empty benchmark all rows stay."""
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return found.where(F.size("_benchmark.spans") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each row's ids and of their decoding; a null text counts as empty. Repeated rows come back as
    often as they came."""
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, over the whole documents table; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            docs = scratch.write(stage(spark, docs, sf_dir), keep=k + 1 == len(STAGES))
    return docs
