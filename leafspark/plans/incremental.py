"""Incremental runs: which pages and stages to do again, one ledger row for each, and the manifest of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.config import Options
from leafspark.operators import reports as R
from leafspark.operators import state as D


def plan(spark: SparkSession, sources: DataFrame, state: DataFrame, flags: DataFrame, options: Options | None = None) -> DataFrame:
    """(page_id, stage) to run: all stages of new and changed pages (the layout changed, so all that depends on it), and
    the dirty ones of the others with what follows from them. force takes everything, skip leaves stages out."""
    run = (options or Options()).run
    status = D.detect_changes(sources, state)
    stages = F.explode(F.array(*[F.lit(s) for s in D.STAGES])).alias("stage")
    if run.force:
        todo = status.where("status <> 'gone'").select("page_id", stages)
    else:
        fresh = status.where("status IN ('new', 'changed')").select("page_id", F.lit("layout").alias("stage"))
        dirty = flags.join(status.where("status = 'same'").select("page_id"), "page_id", "left_semi").select("page_id", "stage")
        todo = D.dirty_after(spark, fresh.union(dirty))
    return todo.where(~F.col("stage").isin(list(run.skip))) if run.skip else todo


def ledger(todo: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Planned stages with their outcome (page_id, stage, ok, ms, error); what has none was skipped."""
    o = outcomes.select("page_id", "stage", "ok", "ms", "error")
    state = F.when(F.col("ok").isNull(), "skipped").when(F.col("ok"), "done").otherwise("failed")
    return todo.join(o, ["page_id", "stage"], "left").select("page_id", "stage", state.alias("outcome"), F.coalesce("ms", F.lit(0)).alias("ms"), "error")


def flags_after(flags: DataFrame, run: DataFrame) -> DataFrame:
    """Dirty flags after a run: planned stages that weren't done stay or become dirty."""
    done = run.where("outcome = 'done'").select("page_id", "stage")
    left = run.where("outcome <> 'done'").select("page_id", "stage")
    return D.mark_done(flags.select("page_id", "stage"), done).union(left).distinct()


def manifest(run: DataFrame, bubbles: DataFrame) -> DataFrame:
    """One row for the run: pages by status, bubbles, exit code. A page fails if a stage failed and none was done, is
    partial if some were, and skipped if none ran."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    per = run.groupBy("page_id").agg(count("failed").alias("f"), count("done").alias("d"))
    status = F.when((F.col("f") > 0) & (F.col("d") > 0), "partial").when(F.col("f") > 0, "failed").when(F.col("d") == 0, "skipped").otherwise("success")
    n = bubbles.groupBy("page_id").agg(F.count("*").alias("bubbles"))
    entries = per.join(n, "page_id", "left").select("page_id", status.alias("status"), F.coalesce("bubbles", F.lit(0)).alias("bubbles"))
    return R.manifest_rollup(entries.withColumn("run", F.lit(1)), ["run"]).drop("run")


def rerender(bubbles: DataFrame, page_id, bubble_id: int) -> DataFrame:
    """Bubbles with one render hash cleared, so the next run renders it and takes the others from the cache."""
    hit = (F.col("page_id") == F.lit(page_id)) & (F.col("bubble_id") == bubble_id)
    return bubbles.withColumn("render_hash", F.when(hit, "").otherwise(F.col("render_hash")))
