"""Shared pieces: the folder all executors see, written tables that cut lineage, ranges of ids."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and the master is local (tests), a temporary one."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.gettempdir()
    root = f"{set_dir.rstrip('/')}/spanlake-{spark.sparkContext.applicationId}"
    if root not in _made:
        _made.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session has ended; the folder stays
        return


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each action begun in here go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder (to path, if given) and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """Ascending upper bounds (exclusive of the last range) that cut key into about equal ranges.

    One pass over the key column alone. The list has at most ranges - 1 entries, whatever the rows."""
    if ranges < 2:
        return []
    cuts = [i / ranges for i in range(1, ranges)]
    got = df.agg(F.percentile_approx(key, cuts, 10_000)).first()[0]
    return sorted(set(got or []))


def range_id(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below key: 0 .. len(bounds); null is 0. Two levels, so long lists stay cheap."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = F.array(*[F.lit(int(b[0])) for b in blocks])
    fine = F.array(*[F.array(*[F.lit(int(x)) for x in b]) for b in blocks])
    coarse = F.size(F.filter(firsts, lambda x: x < key))
    inner = F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), lambda x: x < key))
    return F.when(key.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + inner).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, records: int = 2_000, size: str = "16m") -> None:
    """Arrow batches to Python are bounded by bytes too, as one text may be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """All rows of the batch in order, in runs whose texts in column have at most size bytes; a longer text is a run of its own.

    What a Python worker makes of a run at once, many times its bytes, stays small: workers are kept, with their memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def make_dir(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
