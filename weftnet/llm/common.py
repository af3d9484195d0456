"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftnet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftnet/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that staged() wrote, after the last plan that reads them has run."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/weftnet/" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_staging(spark: SparkSession) -> None:
    """Delete the tables that staged() wrote for this application, once their results are no longer needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftnet/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def digest(*columns: Column) -> Column:
    """128-bit digest of the columns' strings; null differs from the empty string."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]).cast("binary")))


def whole(df: DataFrame, names: list[str] | None = None) -> Column:
    """The named columns (all by default) as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)])


def row_hash(df: DataFrame, names: list[str] | None = None, seed: int = 0) -> Column:
    """64-bit hash of the named columns (all by default) but those that hold maps, which have no hash."""
    hashable = [c for c in (df.columns if names is None else names) if "map<" not in df.schema[c].dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *[F.col("`" + c.replace("`", "``") + "`") for c in hashable])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ddl(df: DataFrame, names: list[str]) -> str:
    """Schema string of the named columns, for mapInArrow and its like."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


#: A key with more than this share of all rows is dealt to several tasks by salted_join; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.002


def salted_join(rows: DataFrame, small: DataFrame, key: str, spread: Column, hot_share: float = HOT_SHARE) -> DataFrame:
    """rows left-joined to small, which has a row for each key, with the rows of frequent keys dealt to several tasks.

    Keys with over hot_share of all rows are counted out first; there are at most 1 / hot_share, so they may be broadcast. Their
    rows get one of n * 2 / (hot_share * total) salts by a hash of `spread`, and their row of small is repeated for each salt.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    least = max(1.0, hot_share * total)
    hot = staged(counts.filter(F.col("_n") > least).select(F.col(key).alias("_hot"), F.ceil(2 * F.col("_n") / least).cast("int").alias("_salts")), "hot-keys")
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_hot", "_salts")
    right = small.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_salts")
    return left.join(right, [key, "_salt"], "left").drop("_salt")
