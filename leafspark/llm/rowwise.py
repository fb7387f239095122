"""Columns that are worked out from one text at a time, by an Arrow function over slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .scratch import small_batches
from .words import CHUNK_BYTES, chunks


def struct_column(work: Callable[[list[bytes | None]], list], returns: str, text: Column, limit: int = CHUNK_BYTES) -> Column:
    """A struct column with fields as in the DDL string returns. work gets texts in UTF-8 (None for null) and gives a
    list of values, or an Arrow array, for each field."""
    small_batches(SparkSession.active())
    schema = StructType.fromDDL(returns)
    kind = to_arrow_type(schema)

    def run(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = []
        for _, texts in chunks(iter([batch]), limit=limit):
            fields = work(texts)
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(fields, kind)]
            parts.append(pa.StructArray.from_arrays(arrays, fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, schema, ArrowUDFType.SCALAR)(text)
