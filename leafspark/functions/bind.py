"""A value that an expression uses several times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value); Spark alone computes a value in branches again wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
