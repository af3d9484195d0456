"""A corpus from raw documents to packed token sequences; counted as part of weftnet.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm import langid, line_dedup, mixing, packing, shingles
from weftnet.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text with fewer letters than this isn't rejected for being unlike all languages.
LEAST_LETTERS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those of LEAST_LETTERS or more that no learned language describes better than chance does.

    A missing label is filled with the prediction; labels that are there stay.
    """
    found = langid.identify(docs, langid.learn(docs), list(COLUMNS))
    unlike = (F.col("bits_per_char") > F.col("chance_bits")) & (F.length("text") >= LEAST_LETTERS)
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & ~unlike)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; a text that is left without any line is kept as an empty one."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each group linked by a similarity of 0.8 or more over five-word shingles; op3's four bits hold for its query only."""
    return shingles.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return packing.pack(packing.cut_into_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Parsing, winnowing, fingerprints and packing can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
