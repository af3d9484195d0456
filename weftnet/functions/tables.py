"""Small helpers on tables: staging, dense ids, top rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftnet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/weftnet/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path in it)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def bytes_of(spark: SparkSession, path: str) -> int:
    fs, at = file_system(spark, path)
    return fs.getContentSummary(at).getLength()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that isn't there yet, whole or not at all: under another name first, which then is changed."""
    jvm = spark.sparkContext._jvm
    fs, at = file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:12]}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    source = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def write_sorted(df: DataFrame, path: str, *keys: str, group_bytes: int = 256 * 1024, mode: str = "errorifexists") -> None:
    """df as Parquet, dealt by range of keys and sorted by them, in small row groups: a reader of one key skips all others by their statistics."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).option("parquet.block.size", group_bytes).parquet(path)


def dense_ids(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with ids 0, 1, ... in the given order (which should be total).

    Rows are dealt by range and numbered in their partition; the partitions' counts, a row each, give where its numbers start.
    No partition holds more than its share, so a vocabulary of any size can be numbered.
    """
    names = df.columns
    keyed = df.withColumns({f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = staged(ranged, name)
    starts = placed.groupBy("_part").count().withColumn("_first", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return placed.withColumn("_at", inside).join(F.broadcast(starts.select("_part", "_first")), "_part").select((F.col("_first") + F.col("_at")).alias(name), *names)


def top_rows(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """The first k rows in the given order; all for None, none for k <= 0."""
    if k is None:
        return df.orderBy(*order)
    return df.orderBy(*order).limit(k) if k > 0 else df.limit(0)
