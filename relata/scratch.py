"""Tables that cut lineage, kept in the folder the session shares between machines."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if driver and tasks are one process (tests),
    else an error: other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="relata-"))
        base = _local[0]
    return base.rstrip("/")


def _register(spark: SparkSession, path: str) -> None:
    if not _made:
        atexit.register(sweep)
    _made.append((spark, path))


def sweep() -> None:
    """Delete every table that `saved` has written; lazily built results that read them must be done."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its owner clears the shared folder
            return


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, swept like the tables."""
    path = f"{shared_dir(spark)}/relata-{uuid.uuid4().hex}/{label}"
    _register(spark, path)
    return path


def saved(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df written as Parquet (partitioned by columns, if asked) to the shared folder and read back, so that no executor's loss
    repeats the work before."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches that go to Python in what runs within are of about `size` bytes at most; a task has several copies of one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like `saved`, hashed on key, so that later joins on the key read it in place without a shuffle. The catalog has the
    table's name only while it is written: the plan that is returned keeps its files and its hashing."""
    spark = df.sparkSession
    name = f"relata_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _register(spark, path)
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved now
    spark.sql(f"DROP TABLE {name}")
    return table


def bytes_of(df: DataFrame) -> int:
    """The bytes of the files that df reads, all columns counted; 0 where that is not known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return size if size < 1 << 60 else 0


def gathered(df: DataFrame, parts: int | None) -> DataFrame:
    """df in at most so many partitions, or one for each core if those are more: a small table doesn't become many small files.
    As it is where parts is None, for an input of unknown size."""
    return df if parts is None else df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, parts))


def parts_of(df: DataFrame, part_bytes: int = 8 << 20) -> int | None:
    """How many partitions tables made from df's rows should have, by the bytes of the files that it reads."""
    size = bytes_of(df)
    return size // part_bytes if size else None


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files have splits for less than half of them, so that work on each row isn't one task's;
    what moves is half a split for each core at most. Larger inputs, and very small ones, stay as they are."""
    spark = df.sparkSession
    number = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    split, cost = (number(spark.conf.get(f"spark.sql.files.{n}")) for n in ("maxPartitionBytes", "openCostInBytes"))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if cost < bytes_of(df) < cores * split // 2 else df
