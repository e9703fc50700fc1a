"""Shared plumbing: table reads, the shared scratch folder, Arrow batch sizes, folds."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch, at most.
ROWS, BYTES = 1000, 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches, so that a worker holds a few MB of text however long the documents are. Spark reads these
    two settings when a plan runs, not when it is made, so they hold for the session; a lower setting stays."""
    for key, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key).removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that this Python worker holds but no longer uses back to the system: workers outlive their tasks, and
    all stages' workers share an executor."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def lean(run):
    """``run`` of a pass over Arrow batches, with a release at the end of each task, also of one that fails."""

    def each(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return each


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for broadcast if a count that stops at ``limit`` rows proves it small; otherwise unmarked (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


_opened: list[Workspace] = []


class Workspace:
    """Tables written to the folder that ``spark.checkpoint.dir`` names, which every executor can read.

    Only where that setting is absent on a single machine (tests) a folder of our own is used; a cluster must name one.
    Tables that nothing reads any more are dropped at once, those that a lazy result still reads when the session ends,
    or when the caller that has written the result closes the workspace.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not root and held.isDefined():
            root = held.get()
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="burdock-")
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/burdock-{uuid.uuid4().hex}"
        path, fs = self._at("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _opened.append(self)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._at(name)
            fs.delete(path, True)

    def close(self) -> None:
        self.drop("")
        if self in _opened:
            _opened.remove(self)


@contextmanager
def passing():
    """Workspaces opened inside are closed at the end: what is still wanted of them has been written elsewhere by then."""
    before = list(_opened)
    try:
        yield
    finally:
        for ws in [w for w in _opened if w not in before]:
            ws.close()
