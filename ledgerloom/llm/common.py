"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own, on a local master alone."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def durable(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and the rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def bucketed(df: DataFrame, label: str, key: str, compression: str = "snappy") -> DataFrame:
    """``durable``, in as many buckets of ``key`` as a shuffle has partitions: plans that group by the key alone read it without a shuffle.

    The rows are in the shared folder; the session's catalog knows them by a name of their own until they are discarded.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", compression).option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out.durable_path, out.durable_name = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` and ``bucketed`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        if name := getattr(df, "durable_name", None):
            spark.sql(f"drop table if exists {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df.durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def in_blocks(array: Column, size: int = 256) -> Column:
    """An array cut into arrays of ``size``; work inside them and over them takes no square of a long array's length."""
    return bound(array, lambda z: F.transform(F.sequence(F.lit(0), F.floor(F.size(z) / size).cast("int")), lambda b: F.slice(z, b * size + 1, size)))


def sums_before(sizes: Column) -> Column:
    """For each element of an array of ints, the sum of all before it."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    each = lambda blocks, sums: F.transform(blocks, lambda block, b: bound(total(F.slice(sums, 1, b)), lambda start: F.transform(block, lambda x, i: start + total(F.slice(block, 1, i)))))
    return bound(in_blocks(sizes), lambda blocks: bound(F.transform(blocks, total), lambda sums: F.flatten(each(blocks, sums))))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold ``rows`` rows at most: texts may be very long, and a batch of them must fit beside the executor's heap.

    The setting stays with the session, as plans read it when they run, after an operator has returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
