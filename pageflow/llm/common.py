"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageflow.sources import io

#: White space of the word rule shared by operators 2, 3 and 6: blank and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders made in each ``scratch`` that is open.
_scratch: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    path = io.new_folder(spark, name)
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the folders that are made meanwhile. What is to last has its folder made before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete_folder(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once and keep it as Parquet in the shared folder, so that losing an executor costs no recomputation.

    A checkpoint would do the same, but computes its last stage twice, once for the count that starts it.
    """
    return stored_at(df, new_folder(df.sparkSession, name))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows of an Arrow batch, for stages that send whole texts to Python workers.
TEXT_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it. Shuffle files go as soon as it is written: nothing else reads them."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``stored`` for small intermediate tables."""
    return stored(df, "cut")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``new_folder`` through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def word_count(text: Column) -> Column:
    """Number of words of WORD; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` suffices unless the text has other characters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str, rows_a_bucket: int = 2_000, most_buckets: int = 1_000_000) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of the same ``keys`` that come before this one.

    No task holds a whole key: the rows of a key are dealt to buckets by a hash of ``order``, the buckets'
    sums are accumulated in a table of one row a bucket (or, of more than ``most_buckets``, in buckets of buckets), and only rows
    within a bucket are sorted. The order
    of rows is therefore (bucket, ``order``): any fixed order serves here. Ties in ``order`` must be equal rows.
    """
    n = df.count()
    buckets = max(1, -(-n // rows_a_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_sum"))
    if buckets <= most_buckets:
        starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    else:
        starts = running_total(sums.withColumnRenamed("_bucket", "_b"), keys, ["_b"], "_sum", "_start", rows_a_bucket, most_buckets)
        starts = starts.drop("_sum").withColumnRenamed("_b", "_bucket")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_bucket"]]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    return (
        local.alias("l")
        .join(starts.alias("r"), on)
        .select(*[f"l.`{c}`" for c in df.columns], (F.col("r._start") + F.col("l._local")).alias(out))
    )
