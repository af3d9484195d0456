"""Document tables: doc_id, text, meta."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.functions.tables import dense_ids
from weftnet.functions.text import strip
from weftnet.sources.csv_splits import read_csv

META = "map<string,string>"
DOCUMENTS = f"doc_id long, text string, meta {META}"


def from_texts(spark: SparkSession, texts: Iterable[str], ids: Iterable | None = None, meta: Iterable[Mapping[str, Any]] | None = None) -> DataFrame:
    """Documents of strings at hand, numbered from 0 or with the given ids (as many as both have)."""
    texts = list(texts)
    if any(not isinstance(t, str) for t in texts):
        raise TypeError("texts must be strings")
    keys = list(range(len(texts))) if ids is None else list(ids)
    metas = [{str(k): str(v) for k, v in m.items()} for m in meta] if meta is not None else [{}] * len(texts)
    rows = list(zip(keys, texts, metas, strict=False))
    kind = "string" if any(isinstance(k, str) for k, _, _ in rows) else "long"
    docs = spark.createDataFrame([(str(k) if kind == "string" else k, t, m) for k, t, m in rows], f"doc_id {kind}, text string, meta {META}")
    return unique(docs)


def from_txt(spark: SparkSession, path: str, delimiter: str = "\n", encoding: str = "UTF-8") -> DataFrame:
    """A document for each block of a text file, or of each file of a folder: stripped, empty ones left out, numbered in file order.

    Blocks are records of Spark's text reader, so a large file is read in splits.
    """
    if encoding.upper().replace("-", "") != "UTF8":
        blocks = F.posexplode(F.split(F.decode("content", encoding), re.escape(delimiter))).alias("_at", "value")
        rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"), F.lit(0).alias("_split"), blocks)
    else:
        rows = spark.read.text(path, lineSep=delimiter).select("value", *_placed())
    rows = rows.select(strip(F.col("value")).alias("text"), *PLACE).filter("text <> ''")
    return dense_ids(rows, list(PLACE), "doc_id").select("doc_id", "text", F.create_map().cast(META).alias("meta"))


#: Where a row of a file stands: its file, its split of the file, its place among the rows of the split's task.
PLACE = ("_file", "_split", "_at")


def _placed() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at")]


def from_csv(spark: SparkSession, path: str, text_column: str = "text", id_column: str | None = None, delimiter: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A document for each row of a CSV or TSV file with a header; other named columns become meta. A missing column is a ValueError.

    UTF-8 files are read in splits, also where quoted fields hold line breaks; those of other encodings by one task each.
    """
    sep = delimiter or ("\t" if path.lower().endswith(".tsv") else ",")
    if encoding.upper().replace("-", "") == "UTF8":
        rows = read_csv(spark, path, sep).withColumn("_split", F.lit(0))
        places = [F.col(c) for c in PLACE]
    else:
        rows = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', encoding=encoding)
        places = _placed()
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in PLACE and not re.fullmatch(r"_c\d+", c)], *places)
    for column in [text_column, *([id_column] if id_column else [])]:
        if column not in rows.columns:
            raise ValueError(f"{path} has no column {column!r} (it has {', '.join(c for c in rows.columns if c not in PLACE)})")
    return from_records(rows, text_column, id_column, PLACE)


def from_records(rows: DataFrame, text_column: str = "text", id_column: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A document for each row of a DataFrame: text stripped, a null text an error when run, other columns to meta as strings.

    Without id_column rows are numbered by the columns of order, which don't become meta, or else as they come in the DataFrame.
    """
    text = F.when(F.col(text_column).isNull(), F.raise_error(F.lit(f"a record has no {text_column!r}"))).otherwise(strip(F.col(text_column).cast("string")))
    rest = [c for c in rows.columns if c not in (text_column, id_column, *order)]
    pairs = [x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    meta = F.create_map(*pairs).cast(META) if pairs else F.create_map().cast(META)
    if id_column:
        return unique(rows.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"), meta.alias("meta")))
    places = [F.col(c) for c in order] or [F.monotonically_increasing_id().alias("_at")]
    made = rows.select(text.alias("text"), meta.alias("meta"), *places)
    return dense_ids(made, list(order) or ["_at"], "doc_id").select("doc_id", "text", "meta")


def from_table(spark: SparkSession, path: str, text_column: str = "text", id_column: str | None = "doc_id", format: str = "parquet") -> DataFrame:
    """Documents of any table of files that Spark reads; without id_column they are numbered by file and place."""
    rows = spark.read.format(format).load(path)
    return from_records(rows.select("*", *_placed()), text_column, id_column, PLACE) if not id_column else from_records(rows, text_column, id_column)


def unique(docs: DataFrame) -> DataFrame:
    """docs; a repeated doc_id is a ValueError."""
    if twice := docs.groupBy("doc_id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"document id {twice[0]['doc_id']!r} occurs more than once")
    return docs


def add(docs: DataFrame, more: DataFrame | str, doc_id: Any = None, meta: Mapping[str, Any] | None = None) -> DataFrame:
    """docs and more documents; an id in both is a ValueError.

    A string is one document, under doc_id, or else under the number of documents, or the next that no document has; with its meta.
    """
    if isinstance(more, str):
        if doc_id is None:
            doc_id = docs.count()
            while docs.filter(F.col("doc_id") == F.lit(doc_id)).limit(1).count():
                doc_id += 1
        own = {str(k): str(v) for k, v in (meta or {}).items()}
        more = docs.sparkSession.createDataFrame([(doc_id, more, own)], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, meta {META}")
    return unique(docs.unionByName(more))


def get(docs: DataFrame, doc_id: Any):
    row = docs.filter(F.col("doc_id") == doc_id).first()
    if row is None:
        raise KeyError(doc_id)
    return row


def head(docs: DataFrame, n: int) -> DataFrame:
    return docs.orderBy("doc_id").limit(max(n, 0))


def load_corpus(spark: SparkSession, path: str, text_column: str = "text", id_column: str | None = None, delimiter: str | None = None) -> DataFrame:
    """Documents by the file's suffix: csv, tsv, parquet, json, orc; all else is text, one document a line."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        return from_csv(spark, path, text_column, id_column, delimiter)
    if suffix in ("parquet", "json", "orc"):
        return from_table(spark, path, text_column, id_column, suffix)
    return from_txt(spark, path)
