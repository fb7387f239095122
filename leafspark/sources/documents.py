"""Sources and sinks: nested page documents, image directories, vocabularies, detections, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nested document of a page, and what a missing field of a bubble counts as.
BUBBLE = (
    "bubble_id INT, bbox ARRAY<INT>, polygon ARRAY<ARRAY<DOUBLE>>, reading_order INT, panel_id INT, bubble_type STRING, detection_conf DOUBLE, raw_text STRING, "
    "corrected_text STRING, ocr_confidence DOUBLE, translated_text STRING, refined_text STRING, tone STRING, emphasis_words ARRAY<STRING>, typography_preset STRING, "
    "font_size_used INT, render_score DOUBLE, provider_used STRING, inpaint_provider STRING, render_hash STRING, manually_edited BOOLEAN, skip_reason STRING, timings MAP<STRING,DOUBLE>"
)
STAGES = ("layout", "ocr", "ocr_correction", "translation", "refinement", "inpaint", "render", "composite", "export")
PAGE = (
    f"metadata_version STRING, page_id STRING, source_path STRING, output_path STRING, image_width INT, image_height INT, processed_at STRING, bubbles ARRAY<STRUCT<{BUBBLE}>>, "
    f"dirty_flags STRUCT<{', '.join(f'{s} BOOLEAN' for s in STAGES)}>, stage_hashes STRUCT<{', '.join(f'{s}_hash STRING' for s in STAGES[:-1])}>, total_bubbles INT, translated_count INT, "
    "skipped_count INT, avg_ocr_conf DOUBLE, avg_render_score DOUBLE, providers_used MAP<STRING,STRING>, timings MAP<STRING,DOUBLE>, error STRING, failed_stages ARRAY<STRING>"
)
DEFAULTS = {
    "reading_order": -1, "panel_id": -1, "bubble_type": "bubble", "detection_conf": 0.0, "raw_text": "", "corrected_text": "", "ocr_confidence": 0.0, "translated_text": "", "refined_text": "",
    "tone": "neutral", "typography_preset": "bubble", "font_size_used": 0, "render_score": 0.0, "provider_used": "", "inpaint_provider": "", "render_hash": "", "manually_edited": False, "skip_reason": "",
}
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")


def read_documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """One struct column `page` from JSON texts: unknown fields are dropped, malformed texts give null."""
    parsed = F.from_json(column, PAGE, {"mode": "PERMISSIVE"})
    good = F.try_parse_json(column).isNotNull()
    return texts.withColumn("page", F.when(good, parsed))


def bubbles_of(pages: DataFrame) -> DataFrame:
    """One row for each bubble with an id and a box, missing fields defaulted; page_id first."""
    b = pages.where("page IS NOT NULL").select("page.page_id", F.explode("page.bubbles").alias("b")).select("page_id", "b.*").where("bubble_id IS NOT NULL AND bbox IS NOT NULL")
    return b.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})


def dirty_flags(pages: DataFrame) -> DataFrame:
    """(page_id, stage) of stages that are dirty; a missing flag counts as dirty."""
    flags = F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(f"page.dirty_flags.{s}"), F.lit(True)).alias("dirty")) for s in STAGES])
    return pages.where("page IS NOT NULL").select("page.page_id", F.explode(flags).alias("f")).where("f.dirty").select("page_id", "f.stage")


def write_documents(bubbles: DataFrame) -> DataFrame:
    """(page_id, value): a JSON document of every page, bubbles sorted by id; ready for a text or JSON sink."""
    fields = [c for c in bubbles.columns if c != "page_id"]
    pages = bubbles.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("bubble_id", *[c for c in fields if c != "bubble_id"]))).alias("bubbles"))
    return pages.select("page_id", F.to_json(F.struct(F.lit("1.0").alias("metadata_version"), F.col("page_id").cast("string").alias("page_id"), "bubbles", F.size("bubbles").alias("total_bubbles"))).alias("value"))


def page_documents(boxes: DataFrame) -> DataFrame:
    """Boxes written as documents (with a field that the schema doesn't know) and read back with defaults."""
    b = boxes.select("page_id", F.col("bubble_id").cast("int").alias("bubble_id"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.when(F.col("bubble_id") % 2 == 0, F.col("conf")).alias("detection_conf"), F.lit("x").alias("unknown_field"))
    read = bubbles_of(read_documents(write_documents(b)))
    return read.select(F.col("page_id").cast("long").alias("page_id"), F.col("bubble_id").cast("long").alias("bubble_id"), F.col("bbox")[2].alias("x2"), "detection_conf", "tone", "reading_order", "manually_edited")


def classify(detections: DataFrame, allowed: tuple[int, ...] = (), page_area: int | None = None, thresholds: dict[str, float] | None = None, least: tuple[int, int] = (20, 15), most: float = 0.70) -> DataFrame:
    """Detections (name, cls, conf, box) that are kept, with their `kind`: areas without text are dropped, then classes
    that aren't allowed (an empty list allows all), low confidences by kind, and boxes that are too small or too large."""
    name, has = F.lower("name"), lambda *ks: F.lower("name").rlike("|".join(ks))
    kind = F.when(has("narr", "box", "caption"), "narration").when(has("sfx", "sound", "effect"), "sfx").otherwise("bubble")
    limits = {"bubble": 0.25, "narration": 0.40, "sfx": 0.18} | (thresholds or {})
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    d = detections.where(~name.rlike("free|panel|background"))
    d = d.where(F.col("cls").isin(*allowed)) if allowed else d
    d = d.withColumn("kind", kind)
    d = d.where(F.col("conf") >= F.when(F.col("kind") == "narration", limits["narration"]).when(F.col("kind") == "sfx", limits["sfx"]).otherwise(limits["bubble"]))
    d = d.where((w >= least[0]) & (h >= least[1]))
    return d.where(w * h <= F.lit(page_area * most)) if page_area else d


def scan_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(name, path, content, length) of image files, without those whose lower-cased name came before; by suffix, then path."""
    f = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    rank = F.array_position(F.array(*[F.lit(s) for s in suffixes]), suffix)
    f = f.select(name.alias("name"), "path", "content", "length", rank.alias("rank")).where("rank > 0")
    first = Window.partitionBy(F.lower("name")).orderBy("rank", "path")
    return f.withColumn("n", F.row_number().over(first)).where("n = 1").select("name", "path", "content", "length")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, place) of a file with a symbol a line: `blank` at 0, empty lines dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\r?\n"), lambda s: s != "").alias("s"))
    return lines.select(F.posexplode(F.concat(F.array(F.lit("blank")), F.col("s"))).alias("place", "symbol")).select("symbol", F.col("place").cast("long").alias("place"))


def write_report(frame: DataFrame, path: str) -> None:
    """A report as CSV with a header; Spark's commit protocol makes it appear as a whole."""
    frame.write.mode("overwrite").option("header", True).csv(path)


def decode_images(files: DataFrame, decoder) -> DataFrame:
    """(path, height, width, pixels) of files; null values where decoder (bytes -> array of height x width x channels)
    fails. Decoders for common formats are plugged in by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    image = decoder(content)
                    rows.append((path, image.shape[0], image.shape[1], image.tobytes()))
                except Exception:  # noqa: BLE001  a file that can't be decoded is a null row, not the end of the run
                    rows.append((path, None, None, None))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["path", "height", "width", "pixels"])

    return files.select("path", "content").mapInArrow(run, "path string, height int, width int, pixels binary")
