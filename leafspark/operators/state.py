"""Incremental state: stage dependencies, dirty flags, change detection, carry-over and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The stages in order, and which stages follow from a change of another.
STAGES = ("layout", "ocr", "ocr_correction", "translation", "refinement", "inpaint", "render", "composite", "export")
EDGES = (
    ("layout", "ocr"), ("layout", "inpaint"), ("layout", "render"), ("layout", "composite"), ("ocr", "ocr_correction"),
    ("ocr", "translation"), ("ocr", "inpaint"), ("ocr_correction", "translation"), ("translation", "refinement"),
    ("translation", "render"), ("refinement", "render"), ("inpaint", "composite"), ("render", "composite"), ("composite", "export"),
)


def stage_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "src string, dst string")


def stage_closure(spark: SparkSession) -> DataFrame:
    """(stage, downstream): every stage that a change of `stage` makes dirty; of fixed size, by a recursive query."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)
    return spark.sql(f"""
        WITH RECURSIVE edges(src, dst) AS (VALUES {values}),
        reach(stage, downstream) AS (SELECT src, dst FROM edges UNION ALL SELECT r.stage, e.dst FROM reach r JOIN edges e ON e.src = r.downstream)
        SELECT DISTINCT stage, downstream FROM reach""")


def dirty_after(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """(page_id, stage) that changes (page_id, stage) make dirty: the stages themselves and all downstream."""
    closure = F.broadcast(stage_closure(spark).withColumnRenamed("stage", "seed"))  # 9 stages: at most 36 rows
    down = changes.withColumnRenamed("stage", "seed").join(closure, "seed").select("page_id", F.col("downstream").alias("stage"))
    return changes.select("page_id", "stage").union(down).distinct()


def mark_done(flags: DataFrame, done: DataFrame) -> DataFrame:
    """Dirty flags (page_id, stage) without those that are done; nothing downstream is cleared."""
    return flags.join(done, ["page_id", "stage"], "left_anti")


def stage_needed(force: Column, dirty: Column) -> Column:
    return force | dirty


def all_clean(*flags: Column) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return ~out


def detect_changes(sources: DataFrame, state: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, status) of new, changed, same and gone keys; both sides have `hash`."""
    s, t = sources.select(key, F.col("hash").alias("new_hash")), state.select(key, F.col("hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("new_hash") != F.col("old_hash"), "changed").otherwise("same")
    return s.join(t, key, "full_outer").select(key, status.alias("status"))


def carry_over(detected: DataFrame, existing: DataFrame, keys: list[str], edited: str = "manually_edited") -> DataFrame:
    """Detected rows, where an existing row with the same keys that was edited by hand replaces the new one whole."""
    columns = [c for c in detected.columns if c not in keys]
    old = existing.where(F.coalesce(F.col(edited), F.lit(False))).select(*keys, F.struct(*columns).alias("_old"))
    new = detected.select(*keys, F.struct(*columns).alias("_new"))
    return new.join(old, keys, "left").select(*keys, F.coalesce("_old", "_new").alias("_row")).select(*keys, "_row.*")


def merge_replies(bubbles: DataFrame, replies: DataFrame) -> DataFrame:
    """Bubbles with text and confidence of the last reply for their id (by `pos`); edited and unmatched ones stay."""
    latest = Window.partitionBy("page_id", "bubble_id").orderBy(F.col("pos").desc())
    last = replies.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("page_id", "bubble_id", F.col("text").alias("_text"), F.col("confidence").alias("_conf"), F.lit(True).alias("_hit"))
    use = F.coalesce(F.col("_hit"), F.lit(False)) & ~F.col("manually_edited")
    return bubbles.join(last, ["page_id", "bubble_id"], "left").select(
        "page_id", "bubble_id", "manually_edited", F.when(use, F.col("_text")).otherwise(F.col("text")).alias("text"),
        F.when(use, F.col("_conf")).otherwise(F.col("confidence")).alias("confidence"), use.alias("replaced"),
    )


def enrich_by_position(left: DataFrame, right: DataFrame, order: list[str], edited: str = "manually_edited") -> DataFrame:
    """The k-th row of a page on the left with the k-th on the right, up to the shorter side. Rows that were edited by
    hand keep their place in the count, but are left alone."""
    w = Window.partitionBy("page_id").orderBy(*order)
    mine = left.withColumn("pos", F.row_number().over(w))
    mine = mine.where(~F.coalesce(F.col(edited), F.lit(False))) if edited in left.columns else mine
    return mine.join(right.withColumn("pos", F.row_number().over(w)).drop(*order), ["page_id", "pos"])


def cache_hits(bubbles: DataFrame, cache: DataFrame) -> DataFrame:
    """(page_id, bubble_id, hit): whether a layer is cached under the bubble's render hash."""
    known = cache.select("page_id", "bubble_id", "render_hash").distinct().withColumn("_hit", F.lit(True))
    return bubbles.join(known, ["page_id", "bubble_id", "render_hash"], "left").select("page_id", "bubble_id", F.coalesce("_hit", F.lit(False)).alias("hit"))


def dirty_bubbles(bubbles: DataFrame, cache: DataFrame) -> DataFrame:
    """Bubbles to render again: edited by hand, or not in the cache under their hash."""
    edited = bubbles.where("manually_edited")
    rest = bubbles.where("not manually_edited").join(cache, ["page_id", "bubble_id", "render_hash"], "left_anti")
    return edited.unionByName(rest).select("page_id", "bubble_id")


def evict(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """The cache without the layers of gone (page_id, bubble_id)."""
    return cache.join(gone, ["page_id", "bubble_id"], "left_anti")


def match_models(configured: DataFrame, installed: DataFrame) -> DataFrame:
    """Configured names (name) with `found`: whether an installed one equals it or contains its part before a colon.

    The installed catalogue is a short list; it is broadcast, and the condition has no equality to join on."""
    base = F.split_part("name", F.lit(":"), F.lit(1))
    hit = configured.join(F.broadcast(installed.select(F.col("name").alias("_i"))), F.contains(F.col("_i"), base) | (F.col("_i") == F.col("name")), "left_semi")
    return configured.join(hit.select("name", F.lit(True).alias("_h")).distinct(), "name", "left").select("name", F.coalesce("_h", F.lit(False)).alias("found"))


def pick_model(installed: DataFrame, preferences: list[str]) -> DataFrame:
    """One row `model`: the first preference that is installed, else the first installed one by place."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferences]), F.col("name")), F.lit(0))
    key = F.struct(F.when(rank > 0, rank).otherwise(len(preferences) + 1).cast("long").alias("r"), F.col("pos").cast("long").alias("p"))
    return installed.agg(F.min_by("name", key).alias("model"))
