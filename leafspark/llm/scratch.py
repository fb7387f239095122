"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch between the JVM and Python, where the session sets none.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: a task holds several of them at once, in and outside the JVM, and
    Spark's own bound is 64 MB. A bound that the user has set stays."""
    if spark.conf.get(_BATCH, "1b") == "1b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set in the context. Where neither is set a temporary folder is set
    as such if all of Spark runs in one process (tests); on a cluster, whose machines don't share such a folder, that is
    an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Parquet tables of one run of an operator. Tables are deleted when they are dropped, on leaving the block at last,
    but for the kept ones, which stay as long as the shared folder does, since a result may be read at any later time.
    Shuffle files of the jobs that write them go when the job has ended: what is written needs them no more."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/leafspark-{uuid.uuid4().hex}", {}
        self.held: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        return self

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(_CLEAN)
        else:
            self.spark.conf.set(_CLEAN, self.before)
        for path in list(self.made.values()):
            self._delete(path)

    def write(self, frame: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{self.root}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        if not keep:
            self.made[id(out)] = path
            self.held.append(out)  # an id stands for one frame as long as it lives
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that write() has returned, once nothing reads them any more."""
        for frame in frames:
            self._delete(self.made.pop(id(frame)))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
