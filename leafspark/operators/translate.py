"""Translation flow: which bubbles go where, and the sliding context of earlier output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.text import is_sfx


def route(manual: Column, translated: Column, source: Column) -> Column:
    """context (edited by hand, kept), blank, sfx or translate, in that order."""
    return (
        F.when(F.coalesce(manual, F.lit(False)) & (F.coalesce(translated, F.lit("")) != ""), "context").when(F.trim(F.coalesce(source, F.lit(""))) == "", "blank")
        .when(is_sfx(source), "sfx").otherwise("translate")
    )


def gate(mode: str, value: Column, threshold: float) -> Column:
    """below: strictly less; above: at least; any other mode lets everything pass."""
    return value < threshold if mode == "below" else value >= threshold if mode == "above" else F.lit(True)


def context_window(emitted: DataFrame, size: int = 3) -> DataFrame:
    """Adds `context`: up to `size` outputs that were emitted before on the page, in reading order. The frame must hold
    emitting rows only, and the output column must not depend on the context (a row-local provider)."""
    w = Window.partitionBy("page_id").orderBy("reading_order", "bubble_id").rowsBetween(-size, -1)
    return emitted.withColumn("context", F.collect_list("output").over(w))
