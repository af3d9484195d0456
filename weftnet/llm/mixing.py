"""Mixing sources to target weights by systematic sampling (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftnet.llm.common import WORD, digest, row_hash, staged, table, whole

#: Weights that the sources take in turn, by code point, null last.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix holds, and the most copies that a document may expect.
TOTAL, MOST = 1.5, 2.0
SEED = 20
#: The random offset is a multiple of 1/GRAIN, so that sums with whole numbers stay exact.
GRAIN = 1 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(_no_source, _source, source_size) -> the same with target, where one row stands for each source.

    Each source gets weight * level words, but at most `most` times its size; the level is the one at which all targets sum to
    `total` times all sizes, which is where resharing the excess by weight ends. Sorted by size over weight, the sources
    that stop at their limit come first, so running sums find the level without a loop. The table has a row a source.
    """
    turn = Window.orderBy("_no_source", "_source")
    by_ratio = Window.orderBy("_ratio", "_no_source", "_source")
    listed = sizes.withColumn("_turn", (F.row_number().over(turn) - 1) % len(weights))
    listed = listed.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_turn") + 1))
    listed = listed.withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    listed = listed.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_weights", F.sum("_weight").over(rest))
    everything = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total))
    # the level if exactly the sources before this one stop at their limits; valid at the first row that it doesn't lift over its own
    listed = listed.withColumn("_level", (everything - F.col("_capped")) / F.col("_weights"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_no_source", "_source", "_level"))).over(Window.partitionBy())["_level"]
    listed = listed.withColumn("target", F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_weight"))))
    return listed.select("_no_source", "_source", "source_size", "target")


def copies(docs: DataFrame, size: Column, order: list[Column], weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED, source_col: str = "source") -> DataFrame:
    """Add size, source_size, target and copies (long) to docs.

    Systematic sampling lays the documents' expected copies in a source end to end, shifts them by the source's one random offset,
    and gives a document a copy for each whole number inside its stretch. The stretches are in order of size, so that
    neighbours which round differently have nearly equal sizes; ties go by a hash and then by `order`, so reruns agree.

    Each document of a source expects target / source_size copies, whatever its size, and gets that number rounded down or up. Taken
    words miss their target by about the size of one large document at most, so by a share that falls with the number of documents.

    The running sum needs only a document's rank in its source. Slim rows (no text) are dealt by range of (source, size, ...),
    so a source with a third of all rows spreads over many partitions; the rank is the rank inside the partition plus the
    counts of the source's earlier partitions, a table of at most one row a partition and source.

    A null source is a source of its own; a null text has size 0; sources of size 0 have target 0 and no copies; rows that
    are equal in everything share their source's copies between them. An empty table gives an empty result. Columns of docs
    named like the added ones are replaced; other columns pass through.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    key = {"_no_source": F.col(source_col).isNull(), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit(""))}
    ties = {"_tie": F.xxhash64(F.lit(seed), *order)} | {f"_tie{i}": c for i, c in enumerate(order)}
    # words are counted once: dealing by range reads its input twice
    keyed = staged(docs.select(whole(docs, names).alias("_row"), size.alias("size"), *[c.alias(n) for n, c in (key | ties).items()]), "sizes")
    placing = ["_no_source", "_source", "size", *ties]
    ranged = keyed.repartitionByRange(*placing).sortWithinPartitions(*placing)
    placed = staged(ranged.withColumn("_part", F.spark_partition_id()), "mixing")

    own = ["_no_source", "_source"]
    part = placed.groupBy(*own, "_part").agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    earlier = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    targets = source_targets(part.groupBy(*own).agg(F.sum("_words").alias("source_size")), weights, total, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(GRAIN)) / F.lit(float(GRAIN))
    targets = staged(targets.withColumns({"_rate": rate, "_offset": offset}), "targets")

    inside = Window.partitionBy(*own, "_part").orderBy("size", *ties)
    ranked = placed.withColumn("_rank", F.row_number().over(inside)).join(part.select(*own, "_part", "_before"), [*own, "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_rank")).join(targets, own)
    crossed = F.floor(F.col("_offset") + F.col("_rate") * F.col("_rank")) - F.floor(F.col("_offset") + F.col("_rate") * (F.col("_rank") - 1))
    return ranked.select("_row.*", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: every document once for each of its copies, with its number copy (from 0); documents without a copy go.

    docs needs doc_id, text and source. The copies are found on slim rows and joined back to the texts by a digest of those
    three; rows equal in all of them are one document whose copies are those of its rows together. Other columns come from the
    row of the least hash among them, so reruns agree. The result has the columns of docs and copy.
    """
    key = digest(F.col("doc_id"), F.col("source"), F.col("text"))
    slim = docs.select("doc_id", "source", key.alias("_key"), n_words(F.col("text")).alias("_n"))
    dealt = copies(slim, F.col("_n"), [F.col("doc_id"), F.col("_key")], **parameters)
    kept = dealt.groupBy("_key").agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    once = docs.select(key.alias("_key"), whole(docs).alias("_row"), row_hash(docs).alias("_order")).groupBy("_key").agg(F.min_by("_row", "_order").alias("_row"))
    return once.join(kept, "_key").select(F.col("_row.*"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("copy"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("_n"))
    dealt = copies(docs, F.col("_n"), [F.col("doc_id")])
    return dealt.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
