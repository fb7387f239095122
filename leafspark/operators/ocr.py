"""Operators on recognised text: decoding, scoring, choice of backend, page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import mean4

MIN_TEXT, MIN_CONFIDENCE, MIN_VALID, MIN_AVERAGE = 2, 0.30, 1, 0.40


def is_valid(text: Column, confidence: Column, points: Column, least: float = 0.5) -> Column:
    """A line that is kept: not blank, confident, and with a polygon."""
    return (F.trim(text) != "") & (confidence >= least) & (F.size(points) >= 3)


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)).cast("double")))
    return F.transform(e, lambda x: x / (F.aggregate(e, F.lit(0.0).cast("double"), lambda a, y: a + y) + F.lit(1e-9).cast("double")))


def ctc_path(steps: Column) -> Column:
    """Best symbol (0-based, first of equals) of every row of an array of arrays."""
    return F.transform(steps, lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1)


def ctc_collapse(path: Column, vocabulary: int) -> Column:
    """Places in the path that are read: not blank (0), not a repeat of the step before, within the vocabulary."""
    marked = F.transform(path, lambda x, i: F.struct(i.alias("i"), x.alias("x"), (x != F.coalesce(F.get(path, i - 1), F.lit(-1))).alias("new")))
    return F.transform(F.filter(marked, lambda m: (m["x"] > 0) & m["new"] & (m["x"] < vocabulary)), lambda m: m["i"])


def ctc_decode(steps: Column, charset: list[str]) -> Column:
    """Struct of text and confidence (mean of the read steps' probabilities, 0 if there is none); charset[0] is blank."""
    path = ctc_path(steps)
    places = ctc_collapse(path, len(charset))
    chars = F.array(*[F.lit(c) for c in charset])
    text = F.array_join(F.transform(places, lambda i: F.get(chars, F.get(path, i))), "")
    probs = F.transform(places, lambda i: F.array_max(softmax(F.get(steps, i))))
    mean = F.aggregate(probs, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(places)
    return F.struct(text.alias("text"), F.when(F.size(places) > 0, mean).otherwise(0.0).alias("confidence"))


def needs_transpose(steps: Column) -> Column:
    """Logits lie the wrong way round if there are more steps than symbols."""
    return F.size(steps) > F.size(F.get(steps, 0))


def transpose(steps: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(steps, 0)) - 1), lambda j: F.transform(steps, lambda row: F.get(row, j)))


def top_symbols(row: Column, k: int = 5) -> Column:
    """The k largest values with their places, largest first, of equals the first."""
    return F.slice(F.array_sort(F.transform(row, lambda p, i: F.struct((-p).alias("rank"), i.alias("symbol")))), 1, k)


def page_scores(lines: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: number of lines and of valid ones, exact sum of the valid confidences, their mean, verdict and reason."""
    valid = (F.length(F.trim("text")) >= MIN_TEXT) & (F.col("confidence") >= MIN_CONFIDENCE)
    s = lines.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.count_if(valid).alias("n_valid"),
        F.coalesce(F.sum(F.when(valid, F.col("confidence").cast("decimal(30,12)"))), F.lit(0)).alias("_sum"),
    )
    s = s.withColumn("avg_conf", F.when(F.col("n_valid") > 0, F.col("_sum").cast("double") / F.col("n_valid")).otherwise(0.0))
    low = F.col("_sum") < (F.col("n_valid") * F.lit(str(MIN_AVERAGE)).cast("decimal(3,2)"))
    reason = F.when(F.col("n_lines") == 0, "empty").when(F.col("n_valid") < MIN_VALID, "none valid").when(low, "low confidence").otherwise("ok")
    return s.withColumn("reason", reason).drop("_sum").withColumn("usable", F.col("reason") == "ok")


def page_text(lines: DataFrame) -> DataFrame:
    """(page_id, text, n, confidence): text of the valid lines in reading order, joined by a blank, how many they are and
    their mean confidence; '' and 0 for a group without any. Lines have text, confidence, polygon and reading_order."""
    good = is_valid(F.col("text"), F.col("confidence"), F.col("polygon"))
    parts = F.array_sort(F.collect_list(F.when(good, F.struct("reading_order", "text"))))
    return lines.groupBy("page_id").agg(
        F.trim(F.array_join(F.transform(parts, lambda s: s["text"]), " ")).alias("text"), F.count_if(good).alias("n"),
        mean4(F.sum(F.when(good, F.col("confidence").cast("decimal(30,12)"))), F.count_if(good)).alias("confidence"),
    )


def choose_backend(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `chosen`: the primary if usable; else the secondary if it has more valid lines, or as many with a
    higher average; both are page_scores."""
    p = primary.select(*keys, F.col("usable").alias("ok"), F.col("n_valid").alias("pv"), F.col("avg_conf").alias("pc"))
    s = secondary.select(*keys, F.col("n_valid").alias("sv"), F.col("avg_conf").alias("sc"))
    better = (F.col("sv") > F.col("pv")) | ((F.col("sv") == F.col("pv")) & (F.col("sc") > F.col("pc")))
    return p.join(s, keys, "left").select(*keys, F.when(F.col("ok") | F.col("sv").isNull(), "primary").when(better, "secondary").otherwise("primary").alias("chosen"))


def circuit_breaker(calls: DataFrame, order: list[str], limit: int = 3, mode: str = "auto", secondary: bool = True) -> DataFrame:
    """calls (page_id, usable, order columns) with `primary_disabled`: whether, before this call, there had been `limit`
    unusable ones in a row on the page. Runs of failures are islands of equal differences of two row numbers. Only a choice that is left open (mode auto), with a secondary
    to turn to, is ever cut off."""
    if mode != "auto" or not secondary:
        return calls.withColumn("primary_disabled", F.lit(False))
    w = Window.partitionBy("page_id").orderBy(*order)
    islands = calls.withColumn("_fails", F.sum(F.when(F.col("usable"), 0).otherwise(1)).over(w)).withColumn("_resets", F.sum(F.when(F.col("usable"), 1).otherwise(0)).over(w))
    before = F.coalesce(F.max("_at_reset").over(w), F.lit(0))
    islands = islands.withColumn("_at_reset", F.when(F.col("usable"), F.col("_fails"))).withColumn("_run", F.col("_fails") - before)
    tripped = F.max(F.when(F.col("_run") >= limit, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands.withColumn("primary_disabled", F.coalesce(tripped, F.lit(0)) == 1).drop("_fails", "_resets", "_at_reset", "_run")
