"""The page flow as one logical plan: boxes to suppressed, clustered and ordered ones, and page statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafspark.operators import boxes as B


def page_order(boxes: DataFrame, width: int, height: int, iou: float = 0.40, standard: bool = False) -> DataFrame:
    """(page_id, bubble_id, panel, reading_order) of the boxes that survive suppression."""
    return B.panelled_order(boxes, width, height, iou, standard)


def ordered_page(boxes: DataFrame, width: int, height: int, iou: float = 0.40, standard: bool = False) -> DataFrame:
    """Boxes that survive suppression, with panel and reading_order."""
    return boxes.join(page_order(boxes, width, height, iou, standard), ["page_id", "bubble_id"])
