"""Arrow batches are bounded by bytes, unless the session has a bound of its own."""

import pyarrow as pa
from pyspark.sql import functions as F

from leafspark.llm import scratch
from leafspark.llm.rowwise import struct_column


def test_batches_are_bounded_by_bytes(spark):
    before = spark.conf.get(scratch._BATCH)
    try:
        spark.conf.unset(scratch._BATCH)
        texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
        size = struct_column(lambda t: [[sum(map(len, t))] * len(t)], "n long", F.col("text"), limit=1 << 40)["n"]
        assert texts.select(size.alias("n")).agg(F.max("n")).first()[0] <= 1.1 * scratch.BATCH_BYTES

        def rows(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

        assert texts.mapInArrow(rows, "n long").agg(F.max("n")).first()[0] <= 1.1 * scratch.BATCH_BYTES
        spark.conf.set(scratch._BATCH, "1m")
        scratch.small_batches(spark)
        assert spark.conf.get(scratch._BATCH) == "1m"
    finally:
        spark.conf.set(scratch._BATCH, before)
