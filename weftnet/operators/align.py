"""Spans to mentions, covered tokens, and checks of annotated documents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Characters (or tokens) of a document that are swept in one run; longer documents are split.
WIDTH = 1 << 14


def swept(events: DataFrame, queries: DataFrame, values: Sequence[str], how: str, width: int = WIDTH) -> DataFrame:
    """queries (doc_id, place, row) with each of values: the sum or maximum (how) over the document's events up to the query's place.

    events: doc_id, place, strict, values. A strict event counts for places behind its own, another for its own too. Events and queries
    are one stream, sorted by place, over which state runs; it is dealt by document and stretch of `width` places, so that long documents
    are split, and a stretch starts with what those before it have left, a row each. Nothing is gathered in a row, and each event
    is read once. A value without any event is null.
    """
    take = {"sum": F.sum, "max": F.max}[how]
    none = F.lit(None).cast(queries.schema["row"].dataType)
    stretch = F.floor(F.col("place") / width).alias("stretch")
    told = events.select("doc_id", F.col("place").cast("long").alias("place"), F.when(F.col("strict"), 2).otherwise(0).alias("turn"), *values, none.alias("row"))
    asked = queries.select("doc_id", F.col("place").cast("long").alias("place"), F.lit(1).alias("turn"), *[F.lit(None).cast(events.schema[v].dataType).alias(v) for v in values], "row")
    stream = told.unionByName(asked).select("*", stretch)
    run = Window.partitionBy("doc_id", "stretch").orderBy("place", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = stream.select("doc_id", "stretch", "place", "row", "turn", *[take(v).over(run).alias(v) for v in values]).filter("turn = 1")
    left = stream.groupBy("doc_id", "stretch").agg(*[take(v).alias(v) for v in values])
    before = Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("doc_id", "stretch", *[take(v).over(before).alias(f"_{v}") for v in values])
    both = inside.join(left, ["doc_id", "stretch"])
    zero = {"sum": lambda v: F.when(F.col(v).isNull() & F.col(f"_{v}").isNull(), None).otherwise(F.coalesce(v, F.lit(0)) + F.coalesce(f"_{v}", F.lit(0))), "max": lambda v: F.greatest(F.col(v), F.col(f"_{v}"))}[how]
    return both.select("doc_id", "place", "row", *[zero(v).alias(v) for v in values])


def _numbered(spans: DataFrame, width: int) -> DataFrame:
    """spans with ord, their place in the document by (start, end, label, text, score), without a window over whole documents."""
    order = ["start", "end", "label", "text", "score"]
    rows = spans.withColumn("_stretch", F.floor(F.col("start") / width))
    left = rows.groupBy("doc_id", "_stretch").agg(F.count("*").alias("_n"))
    left = left.select("doc_id", "_stretch", F.coalesce(F.sum("_n").over(Window.partitionBy("doc_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("doc_id", "_stretch").orderBy(*order)) - 1
    return rows.withColumn("_at", inside).join(left, ["doc_id", "_stretch"]).withColumn("ord", (F.col("_at") + F.col("_before")).cast("int")).drop("_stretch", "_at", "_before")


def align_spans(spans: DataFrame, sentences: DataFrame, tokens: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """(doc_id, start, end, label, score, text) -> mentions, with sent, token_start, token_end and ord.

    Empty spans go. A span belongs to the last sentence that starts at or before it (the first, if none does); its tokens are those it
    overlaps, from the first that ends behind its start to the last that starts before its end. Without tokens both are -1.
    ord is the mention's place in its document by (start, end). Spans of a document without sentences raise when they are run.
    Starts and ends of sentences, tokens and spans are swept in one sorted stream that counts what has been passed: spans may overlap
    and nest, and a document of any length costs its length.
    """
    valid = _numbered(spans.filter(F.col("end") > F.col("start")), width)
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    events = sentences.select("doc_id", F.col("start").alias("place"), F.lit(False).alias("strict"), one.alias("sents"), none.alias("ended"), none.alias("begun"))
    counts = ["sents", "ended", "begun"]
    if tokens is not None:
        events = events.unionByName(tokens.select("doc_id", F.col("end").alias("place"), F.lit(False).alias("strict"), none.alias("sents"), one.alias("ended"), none.alias("begun")))
        events = events.unionByName(tokens.select("doc_id", F.col("start").alias("place"), F.lit(True).alias("strict"), none.alias("sents"), none.alias("ended"), one.alias("begun")))
    row = F.struct("ord", "start", "end", "text", "label", F.col("score").cast("double").alias("score"))
    asked = valid.select("doc_id", F.col("start").alias("place"), F.struct(row.alias("span"), F.lit(False).alias("last")).alias("row"))
    if tokens is not None:
        asked = asked.unionByName(valid.select("doc_id", F.col("end").alias("place"), F.struct(row.alias("span"), F.lit(True).alias("last")).alias("row")))
    found = swept(events, asked, counts, "sum", width)
    at_start = lambda c: F.max(F.when(~F.col("row.last"), F.coalesce(c, F.lit(0))))
    found = found.groupBy("doc_id", F.col("row.span").alias("span")).agg(at_start("sents").alias("_sent"), at_start("ended").alias("_before"), F.max(F.when(F.col("row.last"), F.coalesce("begun", F.lit(0)))).alias("_upto"))
    counted = sentences.groupBy("doc_id").agg(F.count("*").alias("_sentences"))
    found = found.join(counted, "doc_id", "left")
    missing = F.raise_error(F.lit("a document with spans has no sentences")).cast("int")
    sent = F.when(F.col("_sentences").isNull(), missing).otherwise(F.greatest(F.col("_sent") - 1, F.lit(0)).cast("int"))
    if tokens is not None:
        found = found.join(tokens.groupBy("doc_id").agg(F.count("*").alias("_tokens")), "doc_id", "left")
        none_there = F.col("_tokens").isNull()
        ranges = [F.when(none_there, F.lit(-1)).otherwise(F.col("_before").cast("int")), F.when(none_there, F.lit(-1)).otherwise(F.greatest("_before", "_upto").cast("int"))]
    else:
        ranges = [F.lit(-1), F.lit(-1)]
    return found.select("doc_id", "span.ord", sent.alias("sent"), "span.start", "span.end", "span.text", "span.label", "span.score", ranges[0].alias("token_start"), ranges[1].alias("token_end"))


def uncovered_tokens(tokens: DataFrame, mentions: DataFrame, width: int = WIDTH) -> DataFrame:
    """Tokens that no mention of their document covers: by its token range if it has one, else by characters.

    A token is covered if, of the mentions that begin before it ends, one reaches beyond its start: the farthest end so far is
    kept while mentions and tokens are swept in order. Each of the two ways is gone only if there are mentions of its kind.
    """
    ranged = (F.col("token_start") >= 0) & (F.col("token_end") >= F.col("token_start"))
    row = F.struct(*[F.col(c) for c in tokens.columns if c != "doc_id"])
    for own, start, end, place, strict, first in ((ranged, "token_start", "token_end", "pos", False, "pos"), (~ranged, "start", "end", "end", True, "start")):
        theirs = mentions.filter(own)
        if theirs.isEmpty():
            continue
        events = theirs.select("doc_id", F.col(start).alias("place"), F.lit(strict).alias("strict"), F.col(end).alias("reach"))
        found = swept(events, tokens.select("doc_id", F.col(place).alias("place"), row.alias("row")), ["reach"], "max", width)
        tokens = found.filter(F.col("reach").isNull() | (F.col("reach") <= F.col(f"row.{first}"))).select("doc_id", "row.*")
    return tokens


def left_uncovered(begins: np.ndarray, reaches: np.ndarray, tokens: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's tokens (starts, ends) that no span covers: by the spans' characters, and by the token ranges that align_spans gives them.

    begins must grow. As uncovered_tokens, where all of a text's spans and tokens are at hand: nothing is written or exchanged.
    """
    starts, ends = tokens
    at = np.arange(len(starts))
    if not len(begins):
        return at, at
    first = np.searchsorted(ends, begins, "right")
    last = np.maximum(first, np.searchsorted(starts, reaches, "left"))
    found = []
    for far, before, own in ((reaches, np.searchsorted(begins, ends, "left"), starts), (last, np.searchsorted(first, at, "right"), at)):
        most = np.append(-1, np.maximum.accumulate(far))
        found.append(at[most[before] <= own])
    return found[0], found[1]


def invalid_rows(documents: DataFrame, sentences: DataFrame, tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, kind, place, problem) of rows whose offsets or indices don't fit their document; none in a valid corpus."""
    sizes = documents.select("doc_id", F.length("text").alias("_chars"))
    counts = sentences.groupBy("doc_id").agg(F.count("*").cast("int").alias("_n"))
    order = Window.partitionBy("doc_id").orderBy("sent")
    s = sentences.join(sizes, "doc_id", "left").withColumns({"_at": F.row_number().over(order) - 1, "_last": F.coalesce(F.lag("end").over(order), F.lit(0))})
    bad_index = s.filter("sent <> _at").select("doc_id", F.lit("sentence").alias("kind"), F.col("sent").alias("place"), F.lit("index").alias("problem"))
    bad_span = s.filter("not (0 <= start and start < end and end <= _chars) or start < _last").select("doc_id", F.lit("sentence").alias("kind"), F.col("sent").alias("place"), F.lit("span").alias("problem"))
    out = bad_index.unionByName(bad_span)
    for kind, rows, place in (("token", tokens, "pos"), ("mention", mentions, "ord")):
        r = rows.join(sizes, "doc_id", "left").join(counts, "doc_id", "left")
        out = out.unionByName(r.filter("not (0 <= start and start < end and end <= _chars)").select("doc_id", F.lit(kind).alias("kind"), F.col(place).alias("place"), F.lit("span").alias("problem")))
        out = out.unionByName(r.filter("not (0 <= sent and sent < coalesce(_n, 0))").select("doc_id", F.lit(kind).alias("kind"), F.col(place).alias("place"), F.lit("sentence").alias("problem")))
    return out


def validate(documents: DataFrame, sentences: DataFrame, tokens: DataFrame, mentions: DataFrame) -> None:
    """Raises ValueError with the first problems found."""
    if found := invalid_rows(documents, sentences, tokens, mentions).limit(5).collect():
        raise ValueError("; ".join(f"document {r.doc_id}: {r.kind} {r.place} has an invalid {r.problem}" for r in found))
