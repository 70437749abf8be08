"""What the operators of this package share: reading, cutting lineage, partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark drops the shuffle files of a query when it ends, if this is set; what a query has written doesn't need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table by any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a new one if driver and executors are
    one process (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def materialise(df: DataFrame, name: str, random: bool = False) -> DataFrame:
    """Write df once into the shared folder and read it back, so that a lost executor costs no more than
    the tasks it ran. Its shuffle files go at once, the written ones when the application ends. random: most of it is
    hashes, which don't get smaller."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        kind = {"compression": "lz4_raw", "parquet.enable.dictionary": "false"} if random else {"compression": "zstd"}
        df.write.options(**kind).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Texts that go to a Python worker at once.
BATCH_ROWS = 2000


def batched(docs: DataFrame) -> DataFrame:
    """docs, whose batches for Python workers will be short from now on in this session: texts may be long."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


#: Bytes of input that a task of an explicit repartition should get.
TASK_BYTES = 256 << 20


def partitions(spark: SparkSession, df: DataFrame) -> int:
    """Tasks for a repartition of a table: spark.sql.shuffle.partitions, or more where the size of the files it is read from asks
    for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [x for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation"]
    size = sum(int(str(x.stats().sizeInBytes())) for x in files)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
