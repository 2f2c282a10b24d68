"""Session helpers shared by all operators: scratch tables, checked broadcasts, distributed ranking."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a joined side may be broadcast; callers measure first and shuffle beyond it.
BROADCAST_BYTES = 64 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only on a local master, where that is unset, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, with its file system, deleted when the driver's JVM ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/graphloom/{uuid.uuid4().hex}/{label}")
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop.getParent())
    return files.makeQualified(hadoop).toString()


#: Bytes of a plan's estimated size, and rows where the caller knows a bound, that make up one scratch file.
FILE_BYTES, FILE_ROWS = 16 << 20, 100_000


#: Whether Spark (from 4.1 on) deletes an execution's shuffle files at its end, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; its shuffle files go at once.

    Cuts lineage so that lost executors cost only the tasks they held, and fixes values such as row ids. Small tables
    are written in few files: two for each core at most, unless their estimated size, or the bound ``rows``, needs more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if rows is None else 0
    files = rows // FILE_ROWS + 1 if rows is not None else min(size // FILE_BYTES + 1, 1 << 30)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.coalesce(max(2 * spark.sparkContext.defaultParallelism, files)).write.parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` or ``numbered`` returned, once nothing reads them any more; rounds would else add up on disk."""
    for df in staged:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch).getParent()
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value holds, about: 8 for what is fixed, the length of texts, the elements of arrays."""
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [_width(value[f.name], f.dataType) for f in kind], F.lit(8))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 8 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        fixed = kind.elementType.simpleString() in ("bigint", "int", "double")
        each = F.lit(8) if fixed else None
        if fixed:
            return 8 + F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * each
        return 8 + F.coalesce(F.aggregate(value, F.lit(0), lambda a, x: a + _width(x, kind.elementType).cast("int")), F.lit(0))
    return F.lit(8)


def few(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` holds at most ``most`` bytes, row overheads counted as 32. Of more rows than fit only so many are read."""
    if df.limit(most // 40 + 1).count() > most // 40:
        return False
    size = reduce(lambda a, b: a + b, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema], F.lit(32))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def broadcast_if_few(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``most`` bytes, else unchanged so that the join shuffles."""
    return F.broadcast(df) if few(df, most) else df


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; Catalyst would inline it into every lambda iteration."""
    return F.transform(F.array(value), body)[0]


def with_offsets(df: DataFrame, group: Sequence[str], bucket: str, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all smaller buckets of the row's group.

    With an in-bucket window this gives running sums and ranks without one task per group.
    """
    spark_keys = [*group, bucket]
    sums = df.groupBy(*spark_keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*spark_keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias(out))
    return df.join(sums, spark_keys)


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add ``out``: the row's place from 0 in a total ``order``, by ranges of it that are sorted and counted apart.

    The driver holds one count a range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranges.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_range_nth")), "numbered")
    counts = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())
    starts, total = [], 0
    for k, n in counts:
        starts.append((k, total))
        total += n
    table = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    result = placed.join(F.broadcast(table), "_range").withColumn(out, F.col("_start") + F.col("_range_nth")).drop("_range", "_range_nth", "_start")
    result._scratch = placed._scratch
    return result


def join_split(left: DataFrame, right: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of rows with a table unique on ``key`` whose column ``n`` counts the left rows of the key.

    Keys that hold at least 1/``share`` of ``total`` rows (so at most ``share`` keys) are broadcast and joined
    map-side; the others shuffle, none of them hot.
    """
    heavy = right.filter(F.col(n) * share >= F.lit(total))
    hot = left.join(F.broadcast(heavy), key)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return hot.unionByName(rest.join(right.filter(F.col(n) * share < F.lit(total)), key))


def prepare_python(spark: SparkSession, mb: int = 16) -> None:
    """Make Python workers able to run this package's functions on long texts.

    The package goes to the executors as a zip file, once per application; Arrow batches end at ``mb`` MB rather than
    at a count of rows alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)
    context = spark.sparkContext
    if getattr(context, "_graphloom_sent", False):
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._graphloom_sent = True
