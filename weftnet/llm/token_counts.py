"""Token counts with a cache keyed by content and tokenizer digests (operator 6)."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm.common import new_path, row_hash, salted_join, table, whole

#: Texts are handed to the tokenizer in groups of about this many characters, which bounds a worker's memory.
GROUP_CHARS = 1 << 19

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"


def tokenizer_digest(tokenizer_path: str) -> str:
    """Version of a tokenizer: its kind and the digest of its file."""
    with open(tokenizer_path, "rb") as f:
        return f"{os.path.splitext(tokenizer_path)[1][1:]}:{hashlib.sha256(f.read()).hexdigest()}"


_loaded: dict = {}


def _counter(tokenizer_path: str):
    """Function from a list of texts to their token counts; one tokenizer a worker process."""
    if tokenizer_path not in _loaded:
        if tokenizer_path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[tokenizer_path] = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        elif tokenizer_path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
            _loaded[tokenizer_path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"unknown kind of tokenizer file: {tokenizer_path}")
    return _loaded[tokenizer_path]


def encode_counts(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """(content, text) -> (content, n_tokens), by the tokenizer's own library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for batch in batches:
            counts: list[int] = []
            group: list[str] = []
            held = 0
            for text in batch.column("text"):
                group.append(text.as_py())
                held += len(group[-1])
                if held >= GROUP_CHARS:
                    counts += count(group)
                    group, held = [], 0
            counts += count(group) if group else []
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return rows.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; an absent cache is empty."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, text_col: str = "text") -> DataFrame:
    """Add n_bytes and n_tokens (long) to docs.

    Contents are joined by digest, together with the tokenizer's version, to the counts stored at cache_path; only distinct
    contents without a stored count are encoded, and their counts are appended to the cache. Without cache_path the cache is a
    new one in the shared folder, so that equal texts of this input are still encoded once. "Normalised" content is the text
    itself with null as the empty string: any further change could change a count.

    Null and empty texts count 0; repeated rows each get their row; an empty table gives an empty result; other columns of docs
    pass through (columns named n_bytes or n_tokens are replaced). A text of any length is encoded whole. Equal texts, however
    many, meet in partial aggregation before the exchange; the join back to the rows moves the digests and the columns that are
    used afterwards, and deals the rows of a frequent digest to many tasks.
    Two writers that append the same content leave two equal rows, of which reading takes one.
    """
    spark = docs.sparkSession
    cache_path = cache_path or new_path(spark, "token-counts")
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = F.unhex(F.sha2(text.cast("binary"), 256))

    def counts() -> DataFrame:
        cached = read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
        return cached.groupBy(F.col("content").alias("_weft_content")).agg(F.max("n_tokens").alias("n_tokens"))

    distinct = docs.select(content.alias("_weft_content"), text.alias("text")).groupBy("_weft_content").agg(F.first("text").alias("text"))
    misses = distinct.join(counts(), "_weft_content", "left_anti").withColumnRenamed("_weft_content", "content")
    encode_counts(misses, tokenizer_path).select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)

    names = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    rows = docs.select(whole(docs, names).alias("_row"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("_weft_content"), row_hash(docs, names).alias("_spread"))
    return salted_join(rows, counts(), "_weft_content", F.col("_spread")).select("_row.*", "n_bytes", "n_tokens")


#: Rows longer than this many tokens are marked by the query.
TOKEN_LIMIT = 512


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
