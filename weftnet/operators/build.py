"""Mentions and tokens to the tables of a network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftnet.config import NetworkConfig
from weftnet.functions.tables import dense_ids
from weftnet.functions.text import collapse, normal_name

Normaliser = Callable[[Column], Column]


def named_mentions(mentions: DataFrame, normalise: Normaliser = normal_name, aliases: DataFrame | None = None) -> DataFrame:
    """mentions with norm, the identity of their entity together with label.

    aliases (norm, alias) replaces normal names by others, one level deep.
    """
    rows = mentions.withColumn("norm", normalise(F.col("text")))
    if aliases is not None:
        rows = rows.join(aliases, "norm", "left").withColumn("norm", F.coalesce("alias", "norm")).drop("alias")
    return rows


def term_occurrences(tokens: DataFrame, config: NetworkConfig) -> DataFrame:
    """tokens that aren't covered by mentions -> (doc_id, sent, start, end, pos, base, tag): those that count as terms.

    Filters in this order: white space, punctuation, stop words, part of speech; then lemma or surface, lower case, white space
    collapsed, and nothing left out.
    """
    rows = tokens.filter(~F.col("is_space"))
    if not config.include_punctuation:
        rows = rows.filter(~F.col("is_punct"))
    if not config.include_stopwords:
        rows = rows.filter(~F.col("is_stop"))
    if config.term_pos is not None:
        rows = rows.filter(F.col("pos_tag").isin(list(config.term_pos)))
    base = F.when(F.col("lemma") != "", F.col("lemma")).otherwise(F.col("text")) if config.use_lemma else F.col("text")
    base = collapse(F.lower(base) if config.lowercase_terms else base)
    return rows.withColumn("base", base).filter("base <> ''").select("doc_id", "sent", "start", "end", "pos", "base", F.col("pos_tag").alias("tag"))


def entity_vocabulary(mentions: DataFrame) -> DataFrame:
    """(entity_id, norm, label, text, count): ids by first appearance, over documents and the mentions' order in them."""
    return dense_ids(first_mentions(mentions).withColumnRenamed("n", "count"), ["first_doc", "first_ord", "norm", "label"], "entity_id")


def first_mentions(mentions: DataFrame) -> DataFrame:
    """(norm, label, text, n, first_doc, first_ord) of each entity: how often, where and in which words it first stands."""
    first = F.min(F.struct("doc_id", "ord", collapse(F.col("text")).alias("text")))
    found = mentions.groupBy("norm", "label").agg(first.alias("_first"), F.count("*").alias("n"))
    return found.select("norm", "label", F.col("_first.text").alias("text"), "n", F.col("_first.doc_id").alias("first_doc"), F.col("_first.ord").alias("first_ord"))


def term_vocabulary(terms: DataFrame) -> DataFrame:
    """(term_id, text, pos, count): ids by first appearance in token order."""
    return dense_ids(first_terms(terms).withColumnRenamed("n", "count"), ["first_doc", "first_pos", "text", "pos"], "term_id")


def first_terms(terms: DataFrame) -> DataFrame:
    """(text, pos, n, first_doc, first_pos) of each term."""
    found = terms.groupBy("base", "tag").agg(F.min(F.struct("doc_id", "pos")).alias("_first"), F.count("*").alias("n"))
    return found.select(F.col("base").alias("text"), F.col("tag").alias("pos"), "n", F.col("_first.doc_id").alias("first_doc"), F.col("_first.pos").alias("first_pos"))


def sentence_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, sent, keys, n): the sentence incidence, pre-aggregated before any join."""
    return rows.groupBy("doc_id", "sent", *keys).agg(F.count("*").alias("n"))


def cooccurrence_histogram(incidence: DataFrame, window: int) -> DataFrame:
    """(doc_id, sent, entity_id, n) -> (src, dst, delta, n): pairs of mentions by sentence distance, src < dst.

    The band of the join is in its key: the left side is repeated for each distance 0..window at the sentence it then meets, so
    that long documents are dealt by sentence, and each side carries counts, which are multiplied. Sums are of whole
    numbers, so that any order, and any split into batches, gives the same.
    """
    left = incidence.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(window))).alias("delta"), "sent", F.col("entity_id").alias("a"), F.col("n").alias("n_a"))
    left = left.select("doc_id", (F.col("sent") + F.col("delta")).alias("sent"), "delta", "a", "n_a")
    right = incidence.select("doc_id", "sent", F.col("entity_id").alias("b"), F.col("n").alias("n_b"))
    pairs = left.join(right, ["doc_id", "sent"]).filter((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & (F.col("delta") > 0)))
    return pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.col("delta").cast("int").alias("delta")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))


def entity_term_counts(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """Incidences of entities and of terms -> (entity_id, term_id, n): mention times occurrence in the same sentence."""
    both = entities.withColumnRenamed("n", "n_e").join(terms.withColumnRenamed("n", "n_t"), ["doc_id", "sent"])
    return both.groupBy("entity_id", "term_id").agg(F.sum(F.col("n_e") * F.col("n_t")).alias("n"))


def edge_list(histogram: DataFrame, decays: list[float]) -> DataFrame:
    """(src, dst, delta, n) -> (src, dst, weight, count): whole counts for each distance, then their weighted sum by growing distance."""
    counts = [F.coalesce(F.sum(F.when(F.col("delta") == d, F.col("n"))), F.lit(0)).alias(f"n{d}") for d in range(len(decays))]
    by_edge = histogram.groupBy("src", "dst").agg(*counts)
    weight, count = F.lit(0.0), F.lit(0).cast("long")
    for d, value in enumerate(decays):
        weight, count = weight + F.col(f"n{d}") * F.lit(value), count + F.col(f"n{d}")
    return by_edge.select("src", "dst", weight.alias("weight"), count.alias("count")).filter("weight <> 0")


def cooccurrences(mentions: DataFrame, window: int) -> DataFrame:
    """All pairs of mention rows of distinct entities within the window, the earlier one as source.

    mentions: doc_id, sent, start, mention_id, entity_id. Result: doc_id, source, target, delta, first_sent, last_sent, a, b.
    """
    left = mentions.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(window))).alias("delta"), F.col("sent").alias("first_sent"), F.col("mention_id").alias("source"), F.col("entity_id").alias("a"))
    left = left.withColumn("last_sent", F.col("first_sent") + F.col("delta"))
    right = mentions.select("doc_id", F.col("sent").alias("last_sent"), F.col("mention_id").alias("target"), F.col("entity_id").alias("b"))
    pairs = left.join(right, ["doc_id", "last_sent"]).filter((F.col("a") != F.col("b")) & ((F.col("delta") > 0) | (F.col("source") < F.col("target"))))
    return pairs.select("doc_id", "source", "target", "delta", "first_sent", "last_sent", "a", "b")
