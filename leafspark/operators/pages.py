"""Operators on whole pages and runs: traces, audit and diagnosis frames, refreshed documents, artifacts, outcomes, layer cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.sources.documents import BUBBLE

from .reports import exact_sum, mean4

#: The columns of the two reports, in their order.
AUDIT_COLUMNS = ("layout_id", "bbox", "crop_shape", "det_boxes_count", "det_failed", "rec_input_shape", "logits_shape", "needs_transpose", "decoded_own", "decoded_transposed", "final_text", "usable", "fallback_used", "translated", "translated_text", "inpainted")
DIAGNOSIS_COLUMNS = ("idx", "bbox", "bbox_clamped", "crop_shape", "skip_reason", "det_input_hw", "polygon_count", "persp_size", "persp_crop_hw", "rec_input_shape", "logits_shape", "needs_transpose", "decoded_text", "conf", "fallback_used")


def shape_text(shape: Column) -> Column:
    """Numbers as "(a, b)"; one as "(a,)", none as "()"."""
    inner = F.array_join(F.transform(shape, lambda x: x.cast("string")), ", ")
    return F.concat(F.lit("("), inner, F.when(F.size(shape) == 1, ",").otherwise(""), F.lit(")"))


def list_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit("]"))


def audit_frame(traces: DataFrame, keys: list[str]) -> DataFrame:
    """The audit report: keys and AUDIT_COLUMNS, boxes and shapes as text. Counts by page are reports.audit_counts of it."""
    as_text = {"bbox": list_text(F.col("bbox"))} | {c: shape_text(F.col(c)) for c in ("crop_shape", "rec_input_shape", "logits_shape")}
    return traces.select(*keys, *[as_text[c].alias(c) if c in as_text else F.col(c) for c in AUDIT_COLUMNS])


def audit_summary(frame: DataFrame, by: list[str]) -> DataFrame:
    """Bubbles and usable ones, these also in percent (halves to even), fallbacks, translated, filled and turned ones."""
    n = lambda c: F.count_if(F.col(c))
    s = frame.groupBy(*by).agg(F.count("*").alias("total"), n("usable").alias("usable"), n("fallback_used").alias("fallback"), n("needs_transpose").alias("turned"), n("translated").alias("translated"), n("inpainted").alias("inpainted"))
    return s.withColumn("usable_pct", F.bround(F.col("usable") / F.greatest(F.col("total"), F.lit(1)) * 100, 0).cast("long"))


def diagnosis_frame(traces: DataFrame, keys: list[str]) -> DataFrame:
    """The diagnosis report: keys and DIAGNOSIS_COLUMNS, the confidence to four places."""
    as_text = {c: list_text(F.col(c)) for c in ("bbox", "bbox_clamped")} | {c: shape_text(F.col(c)) for c in ("crop_shape", "det_input_hw", "persp_size", "persp_crop_hw", "rec_input_shape", "logits_shape")} | {"conf": F.round("conf", 4)}
    return traces.select(*keys, *[as_text[c].alias(c) if c in as_text else F.col(c) for c in DIAGNOSIS_COLUMNS])


def diagnosis_counts(traces: DataFrame, by: list[str]) -> DataFrame:
    """Crops that are there or empty (with a reason, or never traced), found without polygons, and texts without a letter."""
    empty = (F.get("crop_shape", F.lit(0)) == 0) & (F.get("crop_shape", F.lit(1)) == 0)
    junk = (F.length("decoded_text") > 1) & ~F.col("decoded_text").rlike(r"\p{L}")
    return traces.groupBy(*by).agg(
        F.count_if(~empty).alias("crop_valid"), F.count_if(empty).alias("crop_zero"), F.count_if(empty & (F.col("skip_reason") == "")).alias("untraced"),
        F.count_if(~empty & (F.col("polygon_count") == 0)).alias("poly_zero"), F.count_if(junk).alias("garbage"),
    )


def match_traces(calls: DataFrame, traces: DataFrame) -> DataFrame:
    """calls (page_id, call, bbox) with `idx`: the first trace (page_id, idx, bbox) of an equal box; a call whose box no
    trace has belongs to the same one as the call before."""
    first = traces.groupBy("page_id", "bbox").agg(F.min("idx").alias("_idx"))
    w = Window.partitionBy("page_id").orderBy("call")
    return calls.join(first, ["page_id", "bbox"], "left").withColumn("idx", F.last("_idx", ignorenulls=True).over(w)).drop("_idx")


def normalisation_verdict(first: Column, second: Column) -> Column:
    """Which of two ways to scale pixels finds clearly more text (half as much again): first, second or similar."""
    return F.when(first > second * 1.5, "first").when(second > first * 1.5, "second").otherwise("similar")


def outcome_text(stage: Column, success: Column, skipped: Column, fallback: Column, ms: Column) -> Column:
    """A stage's outcome in a word: ocr:OK+fallback 12ms, ocr:ERR 3ms, ocr:SKIP."""
    ran = F.concat(stage, F.lit(":"), F.when(success, "OK").otherwise("ERR"), F.when(fallback, "+fallback").otherwise(""), F.lit(" "), F.bround(ms, 0).cast("long").cast("string"), F.lit("ms"))
    return F.when(skipped, F.concat(stage, F.lit(":SKIP"))).otherwise(ran)


def page_entries(pages: DataFrame, bubbles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One entry for each page (page_id, source_path) of a batch: status, bubbles, translated ones, averages, stages as
    text, seconds, and the error of the first stage that failed. outcomes are (page_id, place, stage, success, skipped,
    fallback, ms, error). One failed page doesn't touch the others: failed if nothing succeeded, else partial."""
    ran = ~F.col("skipped")
    o = outcomes.groupBy("page_id").agg(
        F.count_if(ran & F.col("success")).alias("n_ok"), F.count_if(ran & ~F.col("success")).alias("n_failed"), F.coalesce(F.sum(F.when(ran, F.col("ms"))), F.lit(0)).alias("ms"),
        F.min_by("error", F.when(ran & ~F.col("success"), F.col("place"))).alias("error"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", outcome_text(F.col("stage"), F.col("success"), F.col("skipped"), F.col("fallback"), F.col("ms")).alias("t")))), lambda x: x["t"]), ", ").alias("stages"),
    )
    b = bubbles.groupBy("page_id").agg(
        F.count("*").alias("total_bubbles"), F.count_if(F.trim("translated_text") != "").alias("translated_count"),
        mean4(exact_sum("ocr_confidence"), F.count_if(F.col("ocr_confidence") > 0)).alias("avg_ocr_conf"), mean4(exact_sum("render_score"), F.count_if(F.col("render_score") > 0)).alias("avg_render_score"),
    )
    ok, failed = F.coalesce("n_ok", F.lit(0)), F.coalesce("n_failed", F.lit(0))
    status = F.when((failed > 0) & (ok > 0), "partial").when(failed > 0, "failed").when(ok == 0, "skipped").otherwise("success")
    number = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return pages.join(o, "page_id", "left").join(b, "page_id", "left").select(
        "page_id", "source_path", status.alias("status"), number("total_bubbles", "long"), number("translated_count", "long"), number("avg_ocr_conf", "double"), number("avg_render_score", "double"),
        (F.floor((F.coalesce("ms", F.lit(0)) + 5) / 10) / 100.0).alias("elapsed_sec"), F.when(failed > 0, F.col("error")).alias("error"), F.coalesce("stages", F.lit("")).alias("stages"),
    )


def refreshed(pages: DataFrame, now: Column | None = None) -> DataFrame:
    """Pages (struct column `page`) as they are saved: counts and averages from their bubbles, and the time of saving."""
    b = F.coalesce(F.col("page.bubbles"), F.array().cast(f"array<struct<{BUBBLE}>>"))

    def mean(field: str) -> Column:
        some = F.filter(F.transform(b, lambda x: x[field].cast("decimal(30,12)")), lambda x: x > 0)
        return mean4(F.aggregate(some, F.lit(0).cast("decimal(38,12)"), lambda s, x: (s + x).cast("decimal(38,12)")), F.size(some))

    page = F.col("page")
    for name, value in (
        ("total_bubbles", F.size(b)), ("translated_count", F.size(F.filter(b, lambda x: F.trim(x["translated_text"]) != ""))), ("skipped_count", F.size(F.filter(b, lambda x: x["skip_reason"] != ""))),
        ("avg_ocr_conf", mean("ocr_confidence")), ("avg_render_score", mean("render_score")), ("processed_at", F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")),
    ):
        page = page.withField(name, value)
    return pages.withColumn("page", page)


def save_pages(pages: DataFrame, folder: str) -> None:
    """Refreshed pages as JSON documents, a folder for each page; only the folders of these pages are replaced."""
    rows = refreshed(pages).select(F.col("page.page_id").alias("page_id"), F.to_json("page").alias("value"))
    rows.repartition("page_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page_id").text(folder)


def write_artifact(frame: DataFrame, folder: str, stage: str) -> None:
    """A stage's result, kept under its name; an older one is replaced."""
    frame.write.mode("overwrite").parquet(f"{folder}/stage={stage}")


def read_artifact(spark: SparkSession, folder: str, stage: str, hashes: DataFrame | None = None) -> DataFrame:
    """A stage's kept result; if hashes (page_id, hash) are given, only of pages whose `hash` is still the same."""
    kept = spark.read.parquet(f"{folder}/stage={stage}")
    return kept if hashes is None else kept.join(hashes, ["page_id", "hash"], "left_semi")


def cache_put(cache: DataFrame, layers: DataFrame) -> DataFrame:
    """The layer cache with these layers, which replace those of the same bubble and hash."""
    return cache.join(layers, ["page_id", "bubble_id", "render_hash"], "left_anti").unionByName(layers)


def invalidate(cache: DataFrame, page_id: int | None = None) -> DataFrame:
    """The cache without the layers of a page, or of all."""
    return cache.where(F.lit(False)) if page_id is None else cache.where(F.col("page_id") != page_id)


def render_dirty(edited: Column, known: Column, now: Column) -> Column:
    """Whether a bubble is rendered again: edited by hand, never rendered, or rendered from other values."""
    return edited | (F.coalesce(known, F.lit("")) == "") | (known != now)


def preset(table: dict[str, str], kind: Column, default: str) -> Column:
    """The entry of a table of presets, or the default's."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind), F.lit(table[default]))


def best_candidate(candidates: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Of each key's candidates the one of the highest score, of equals that with the least tie."""
    order = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in candidates.columns if c not in keys]), order).alias("_c")).select(*keys, "_c.*")
