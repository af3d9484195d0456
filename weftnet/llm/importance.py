"""Resampling by importance towards a target distribution, over hashed n-grams (operator 11).

Texts of a batch are joined with separator sentinels, so that one regex pass over the joined bytes finds the words of all of them; the
documents' offsets are searched for the words' places, n-grams that would cross from one document into the next are masked, and the rest
are counted by bincount.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.functions.tables import dense_ids
from weftnet.llm.common import ddl, digest, row_hash, staged, table, whole

BUCKETS = 10_000
#: Bytes of text that are joined at a time, and the bytes of a word whose checksum is taken for many words at once.
JOINED_BYTES, TOGETHER = 2_000_000, 24
#: What stands between two joined texts; never part of a word.
SENTINEL = b"\x00"

# Words: digits, a to z after lower-casing A to Z, and every byte of a character beyond ASCII.
_WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_GAP_BYTES = bytes(b for b in range(256) if b not in _WORD_BYTES)
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def _crc_table() -> np.ndarray:
    """The 256 steps of crc32, a byte each."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1)
    return values


_CRC = _crc_table()


def _advance(state: np.ndarray, data: np.ndarray, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksum states after the bytes [start, start + size) of data; sizes must fall."""
    state = state.copy()
    reached = len(sizes) - np.searchsorted(sizes[::-1], np.arange(TOGETHER), side="right")  # words with more than j bytes
    for j in range(TOGETHER):
        n = reached[j]
        if n == 0:
            break
        state[:n] = _CRC[(state[:n] ^ data[starts[:n] + j]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(-sizes, -TOGETHER, side="left"))):  # longer words, one by one
        a = int(starts[i])
        state[i] = zlib.crc32(raw[a + TOGETHER : a + int(sizes[i])], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(texts: Sequence[tuple[int, bytes, bool]], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, text, continued) -> (owner of each feature, its bucket, owner of each word), for words and pairs of words.

    The first word of a continued text has been counted before: only its pair with the next one is new.
    """
    joined = SENTINEL.join(t for _, t, _ in texts) + SENTINEL
    begins = np.cumsum([0, *(len(t) + 1 for _, t, _ in texts)])[:-1]
    places = np.fromiter(chain.from_iterable(m.span() for m in _WORD.finditer(joined)), np.int64).reshape(-1, 2)
    if not len(places):
        none = np.empty(0, np.int64)
        return none, none, none
    starts, sizes = places[:, 0], places[:, 1] - places[:, 0]
    of = np.searchsorted(begins, starts, side="right") - 1
    data = np.frombuffer(joined, np.uint8)
    order = np.argsort(-sizes, kind="stable")
    state = np.empty(len(order), np.uint32)
    state[order] = _advance(np.full(len(order), 0xFFFFFFFF, np.uint32), data, joined, starts[order], sizes[order])

    # the pair of a word and the one before it goes on from the state after that one and a space; it counts inside a text only
    same = np.zeros(len(order), bool)
    same[1:] = of[1:] == of[:-1]
    second = order[same[order]]
    first = state[second - 1]
    spaced = _CRC[(first ^ np.uint32(0x20)) & 0xFF] ^ (first >> np.uint32(8))
    pairs = _advance(spaced, data, joined, starts[second], sizes[second])

    owners = np.array([o for o, _, _ in texts], np.int64)
    new = same | ~np.array([c for _, _, c in texts], bool)[of]  # all but the first word of a continued text
    values = np.concatenate([state[new], pairs]) ^ np.uint32(0xFFFFFFFF)
    return owners[np.concatenate([of[new], of[second]])], (values % np.uint32(buckets)).astype(np.int64), owners[of[new]]


def pieces(text: str | None, most: int = JOINED_BYTES) -> Iterator[tuple[bytes, bool]]:
    """A text's bytes, A to Z lower-cased, in pieces of about `most` bytes cut between words.

    Each piece but the first begins with the last word before it and is marked as continued, so that no pair is lost at a cut.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at, last = 0, b""
    while True:
        gap = _GAP.search(data, at + most) if len(data) - at > most else None
        end = gap.start() if gap else len(data)
        part = data[at:end]
        yield (last + b" " + part if last else part), bool(last)
        if end == len(data):
            return
        if head := part.rstrip(_GAP_BYTES):
            last = head[len(head.rstrip(_WORD_BYTES)) :]
        at = end


def _joins(texts: Sequence[str | None], most: int) -> Iterator[list[tuple[int, bytes, bool]]]:
    """The pieces of a batch's texts, with their texts' numbers, in lists of about `most` bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for part, continued in pieces(text, most):
            held.append((i, part, continued))
            size += len(part)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, joined_bytes: int = JOINED_BYTES) -> DataFrame:
    """(bucket int, n long): how often features fall into each bucket; buckets without any are left out. Null texts have no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for own in _joins(batch.column(0).slice(at, 64).to_pylist(), joined_bytes):
                    counts += np.bincount(features(own, buckets)[1], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: 1000 times the log ratio of its smoothed shares in target and source, rounded down.

    A number for each bucket of either table reaches the driver, however large they are.
    """
    counted = []
    for rows in (source, target):
        counts = [0] * buckets
        for r in bucket_counts(rows, text_col, buckets).collect():
            counts[r["bucket"]] = r["n"]
        counted.append(counts)
    s, t = counted
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """A document's own random number: floor(-1000 ln(-ln u)), with u from the digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, joined_bytes: int = JOINED_BYTES) -> DataFrame:
    """docs with n_words, n_features, weight (the mean of the features' gains, rounded down; 0 without features) and score, all long."""
    added = ("n_words", "n_features", "weight", "score")
    names = [c for c in docs.columns if c not in added]
    place = {c: names.index(c) for c in (id_col, text_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            n = batch.num_rows
            words, found, sums = (np.zeros(n, np.int64) for _ in range(3))
            for at in range(0, n, 64):
                texts = columns[place[text_col]].slice(at, 64).to_pylist()
                k = len(texts)
                for own in _joins(texts, joined_bytes):
                    owner, bucket, of_word = features(own, len(gain))
                    words[at : at + k] += np.bincount(of_word, minlength=k)
                    found[at : at + k] += np.bincount(owner, minlength=k)
                    sums[at : at + k] += np.rint(np.bincount(owner, weights=gain[bucket], minlength=k)).astype(np.int64)
            weight = sums // np.maximum(found, 1)
            score = weight + np.array([noise(i, seed) for i in columns[place[id_col]].to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in (words, found, weight, score))], names=[*names, *added])

    rows = docs.select(whole(docs, names).alias("_row"))
    return rows.mapInArrow(run, f"{ddl(docs, names)}, " + ", ".join(f"{c} long" for c in added))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_features, weight, score and rank (long): the documents drawn are those with a rank.

    Of the N documents with least_words words or more, floor(percent * N / 100) of the highest scores are drawn; equal scores go to the
    smaller id (null last), then by a hash of the row. target has a column named as text_col.

    Null and empty texts have no features, weight 0 and no rank, unless least_words is 0; repeated rows are documents of their own; a null
    id counts as the empty string in its random number; an empty table gives an empty result, an empty target makes rare features
    count more. Other columns pass through; columns named as the added ones are replaced. keep_text=False leaves the text out, so
    that it isn't sorted along.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_features", "weight", "score", "rank")]
    rows = scored(docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names]), gains(docs, target, text_col), id_col, text_col, seed)
    kept = names if keep_text else [c for c in names if c != text_col]
    hashed = digest(F.col(text_col)) if keep_text else F.lit(None).cast("binary")
    placed = staged(rows.select(whole(rows, kept).alias("_row"), F.col(id_col).alias("_id"), hashed.alias("_text"), row_hash(rows, kept).alias("_hash"), "n_words", "n_features", "weight", "score"), "scored")
    able = F.col("n_words") >= least_words
    drawn = placed.agg(F.count(F.when(able, 1)).alias("n")).first()["n"] * percent // 100
    order = [(~able).alias("_unable"), -F.col("score"), F.col("_id").isNull(), F.col("_id"), F.col("_text"), F.col("_hash")]
    ranked = dense_ids(placed, order, "_place")
    rank = F.when(able & (F.col("_place") < drawn), F.col("_place") + 1)
    return ranked.select("_row.*", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample(docs, table(spark, sf_dir, "benchmark").select("text"), keep_text=False)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op11_sql() -> str:
    """crc32 of each distinct feature by a fold over its bytes, with a table that is made here by the rule; all else is counting."""

    def counted(name: str, rows: str) -> str:
        return f"""{name}_words AS (SELECT id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM ({rows})),
{name}_grams AS (SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {name}_words WHERE len(w) > 0),
{name} AS (SELECT id, f, count(*) AS n FROM {name}_grams GROUP BY ALL)"""

    table_of = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""
WITH {counted("d", "SELECT row_number() OVER () AS id, doc_id, text FROM documents")},
{counted("b", "SELECT item_id AS id, text FROM benchmark")},
docs AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
crc AS (SELECT list({table_of} ORDER BY i) AS t FROM range(256) r(i)),
hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM b))),
bytes AS (SELECT f, list_transform(generate_series(1, len(h), 2), lambda i: CAST(instr('0123456789ABCDEF', h[i]) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 17 AS BIGINT)) AS y FROM hexes),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, y), lambda c, z: xor(c >> 8, t[(xor(c, z) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, sum(n) AS n FROM d JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM b JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000)))) AS g FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
sums AS (SELECT id, sum(n) AS n_features, sum(n * g) AS total FROM d JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY id),
scored AS (SELECT doc_id, coalesce(len(w), 0) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n_features), 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS z FROM docs LEFT JOIN d_words USING (id) LEFT JOIN sums USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + z DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, weight + z AS score, CASE WHEN n_words >= 20 AND r <= (SELECT count(*) * 25 // 100 FROM scored WHERE n_words >= 20) THEN r END AS rank FROM ranked"""
