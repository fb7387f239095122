"""Aggregates and reports: page statistics, manifests, provider counts, ledgers, audits, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = F.lit


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def exact_sum(column: str, least: float = 0) -> Column:
    """Sum of the values above `least`, without errors that depend on the order of rows."""
    return F.sum(F.when(F.col(column) > least, F.col(column).cast("decimal(30,12)")))


def mean4(total: Column, n: Column) -> Column:
    """Mean to four places, halves up (within 1e-13); 0 for none."""
    return F.when(n > 0, F.floor(total.cast("double") / n * 10000 + F.lit(0.500000001)) / 10000.0).otherwise(0.0)


def page_stats(bubbles: DataFrame) -> DataFrame:
    """Per page: bubbles, translated and skipped ones, and of confidences and scores above 0 number and average."""
    n = lambda c: _count(F.col(c) > 0)
    return bubbles.groupBy("page_id").agg(
        F.count("*").alias("total_bubbles"), _count(F.trim("translated_text") != "").alias("translated_count"), _count(F.col("skip_reason") != "").alias("skipped_count"),
        n("ocr_confidence").alias("n_conf"), mean4(exact_sum("ocr_confidence"), n("ocr_confidence")).alias("avg_ocr_conf"),
        n("render_score").alias("n_score"), mean4(exact_sum("render_score"), n("render_score")).alias("avg_render_score"),
    )


def manifest_rollup(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entry counts by status, sum of bubbles, averages of the pages' averages above 0 (where entries have them), and the
    exit code of a run: 0 without failures, 2 if all failed, else 1."""
    status = lambda s: _count(F.col("status") == s)
    m = entries.groupBy(*by).agg(F.count("*").alias("total"), *[status(s).alias(s) for s in ("success", "failed", "skipped", "partial")], F.sum("bubbles").cast("long").alias("bubbles"), *[mean4(exact_sum(c), _count(F.col(c) > 0)).alias(c) for c in ("avg_ocr_conf", "avg_render_score") if c in entries.columns])
    return m.withColumn("exit_code", F.when(F.col("failed") == 0, 0).when(F.col("failed") == F.col("total"), 2).otherwise(1).cast("long"))


def providers_summary(entries: DataFrame, faithful: bool = False) -> DataFrame:
    """(provider, n): uses of "stage:provider" over the entries' map providers_used.

    faithful=True counts as an append that recounts everything so far: entry k of n (by pos) counts n - k + 1 times."""
    e = entries.select("pos", F.explode("providers_used").alias("stage", "name"))
    key = F.concat_ws(":", "stage", "name").alias("provider")
    if not faithful:
        return e.groupBy(key).agg(F.count("*").alias("n"))
    total = entries.agg(F.count("*").alias("total"))
    weights = _ranks(entries).crossJoin(F.broadcast(total)).select("pos", (F.col("total") - F.col("rank") + 1).alias("weight"))  # total is one row
    return e.join(weights, "pos").groupBy(key).agg(F.sum("weight").cast("long").alias("n"))


def _ranks(entries: DataFrame, parts: int = 64) -> DataFrame:
    """(pos, rank) of a global order of whole numbers, without one task that gets all rows: ranks within ranges of equal
    width, which the least and largest pos fix, plus the rows of the ranges before."""
    ends = entries.agg(F.min("pos").alias("_low"), F.max("pos").alias("_high"))  # one row
    part = F.floor((F.col("pos") - F.col("_low")) * parts / (F.col("_high") - F.col("_low") + 1)).cast("int")
    n = entries.select("pos").crossJoin(F.broadcast(ends)).select("pos", part.alias("part"))
    local = n.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy("pos")))
    sizes = n.groupBy("part").agg(F.count("*").alias("size"))  # a row for each of `parts` ranges
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size")).select("part", "before")
    return local.join(F.broadcast(before), "part").select("pos", (F.col("before") + F.col("local")).alias("rank"))


def stage_timings(ledger: DataFrame) -> DataFrame:
    """(page_id, stage, ms, runs): the last run's time of every stage (by ts, then event_id), and how often it ran."""
    return ledger.groupBy("page_id", "stage").agg(F.max_by("ms", F.struct("ts", "event_id")).alias("ms"), F.count("*").alias("runs"))


def audit_counts(rows: DataFrame, flags: list[str], by: list[str]) -> DataFrame:
    """Rows, and rows with each flag set."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[_count(F.col(f)).alias(f) for f in flags])


def status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def budget_report(components: DataFrame, by: list[str], free: float, margin: float = 1.5) -> DataFrame:
    """Sum of positive needs (to one place), whether it fits into what is free, and whether it is worth saving (less than
    `margin` left). Nothing is known where nothing is free: that counts as safe."""
    r = components.groupBy(*by).agg(F.coalesce(exact_sum("need"), Z(0)).alias("_need"))
    left = F.lit(str(free)).cast("decimal(30,12)") - F.col("_need")
    known = F.lit(free > 0)
    return r.select(*by, (F.floor(F.col("_need").cast("double") * 10 + 0.5) / 10.0).alias("need"), (~known | (left >= 0)).alias("safe"), (known & (left < F.lit(str(margin)).cast("decimal(30,12)"))).alias("suggest"))


def preflight(items: DataFrame) -> DataFrame:
    """(label, worst, failed) of checks (label, status): the most severe status of each label."""
    severity = F.element_at(F.create_map(*[x for s, v in (("ok", 0), ("info", 1), ("warn", 2), ("error", 3)) for x in (Z(s), Z(v))]), F.col("status"))
    return items.groupBy("label").agg(F.max_by("status", severity).alias("worst"), F.bool_or(F.col("status") == "error").alias("failed"))


def background(samples: DataFrame, by: list[str], channel: str) -> DataFrame:
    """Median and number of samples by group; white where there are none."""
    return samples.groupBy(*by).agg(F.coalesce(F.percentile(channel, 0.5), Z(255.0)).alias("median"), F.count(channel).alias("n"))


def homogeneity(samples: DataFrame, by: list[str], channel: str, white: float, ratio: float = 0.92, spread: float = 18.0) -> DataFrame:
    """Whether a group is of one colour: nearly all white, or of a small population deviation."""
    s = samples.groupBy(*by).agg(F.count("*").alias("n"), _count(F.col(channel) > white).alias("n_white"), F.stddev_pop(channel).alias("sd"))
    return s.withColumn("simple", (F.col("n_white") >= F.col("n") * ratio) | (F.col("sd") < spread))


def similarity(a: Column, b: Column) -> Column:
    """1 / (1 + 100 * mean squared difference) of two arrays of one length, else 0."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    mse = F.aggregate(squares, F.lit(0.0).cast("double"), lambda s, x: s + x) / F.size(a)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.lit(1.0).cast("double") / (F.lit(1.0).cast("double") + F.lit(100.0).cast("double") * mse))


def families(fonts: DataFrame) -> DataFrame:
    """One row: the sorted distinct families."""
    return fonts.select("family").distinct().agg(F.array_sort(F.collect_list("family")).alias("families"))
