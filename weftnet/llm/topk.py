"""Exact top-k inner products over a bit-sliced index (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftnet.llm.common import staged, table

#: Whole numbers that a component is turned into: floor(SCALE * x).
SCALE = 256
#: Bit slices of each quantised attribute: what lies below is resolved exactly.
SLICES = 5
#: Rows of an index block, a multiple of 64; rows of a chunk of queries.
BLOCK_ROWS, CHUNK_ROWS = 32_768, 256

PAYLOAD_SCHEMA = "ids binary, vectors binary, dims int"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): whole vectors, without rows of no id and those that hold null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x")))
    return rows.select("id", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones are filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    dims = int(lengths.max(initial=0))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _payloads(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, v) of a partition as payload rows of up to `most` vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def payload() -> pa.RecordBatch:
            dims = max(p.shape[1] for p in parts)
            whole = np.concatenate([np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts])
            small = whole.astype(np.int16) if len(whole) and dims and abs(whole).max() < 1 << 15 else whole
            columns = [pa.array([np.concatenate(ids).astype(np.int64).tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary()), pa.array([dims], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "vectors", "dims"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - held)
                ids.append(part.column(0).to_numpy())
                parts.append(_matrix(pa.array(part.column(1).to_pylist(), pa.list_(pa.int64()))))
                held += part.num_rows
                at += part.num_rows
                if held == most:
                    yield payload()
                    ids, parts, held = [], [], 0
        if held:
            yield payload()

    return rows.mapInArrow(run, PAYLOAD_SCHEMA)


def unpacked(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.int16 if dims and len(vectors) == 2 * dims * len(own) else np.int64
    return own, np.frombuffer(vectors, kind).astype(np.int64).reshape(len(own), dims)


class BitSlicedIndex:
    """Bitmaps of the upper bits of each attribute of a block of vectors.

    An attribute is stored as u = (v >> shift) - least, in `slices` bits or fewer, one bitmap over the rows for each bit and a
    shift of its own for the block. A query's score over the u's is a sum of bitmaps, shifted by the bits of the query's
    components; negative ones add the complement instead. Adding three bitmaps of a weight gives one of that weight and one of
    twice it, until each weight has one: the slices of the score.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, slices: int = SLICES):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        spread = int((vectors.max(axis=0, initial=0) - vectors.min(axis=0, initial=0)).max(initial=0))
        self.shift = max(0, spread.bit_length() - slices)
        upper = vectors >> self.shift
        upper = upper - upper.min(axis=0) if n else upper
        self.bits = max(1, int(upper.max(initial=0)).bit_length())
        self.words = -(-n // 64)
        padded = np.zeros((self.words * 64, dims), np.int64)
        padded[:n] = upper
        planes = [np.packbits((padded >> b & 1).astype(np.uint8).T, axis=1, bitorder="little") for b in range(self.bits)]
        self.ones = np.ascontiguousarray(np.stack(planes)).view(np.uint64).reshape(self.bits, dims, self.words)
        self.all = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the score's bits, from the least significant; the score is offset so that it is never negative."""
        sizes = np.abs(query)
        negative = query < 0
        weights: dict[int, list[np.ndarray]] = {}
        for t in range(int(sizes.max(initial=0)).bit_length()):
            has = sizes >> t & 1 == 1
            for b in range(self.bits):
                weights.setdefault(t + b, []).extend((self.ones[b, has & ~negative], ~self.ones[b, has & negative]))
        out = []
        level = 0
        while weights and level <= max(weights):
            held = np.concatenate(weights.pop(level, [np.zeros((0, self.words), np.uint64)]))
            carries = []
            while len(held) > 1:
                m = max(1, len(held) // 3) if len(held) > 2 else 1
                if len(held) == 2:
                    a, b = held[:1], held[1:]
                    carries.append(a & b)
                    held = a ^ b
                else:
                    a, b, c, rest = held[:m], held[m : 2 * m], held[2 * m : 3 * m], held[3 * m :]
                    ab = a ^ b
                    carries.append(a & b | ab & c)
                    held = np.concatenate((ab ^ c, rest))
            out.append(held[0] if len(held) else np.zeros(self.words, np.uint64))
            if carries:
                weights.setdefault(level + 1, []).extend(carries)
            level += 1
        return out

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, or all if fewer; ties to smaller ids."""
        if query.shape[0] < self.vectors.shape[1]:
            query = np.pad(query, (0, self.vectors.shape[1] - query.shape[0]))
        query = query[: self.vectors.shape[1]]
        within = self.all
        slices = self.score_slices(query)
        # the k-th best score over the slices, from the most significant downward
        rows, above, kth = within, 0, 0
        if int(np.bitwise_count(within).sum()) > k:
            for level in range(len(slices) - 1, -1, -1):
                more = rows & slices[level]
                n = int(np.bitwise_count(more).sum())
                if above + n >= k:
                    rows, kth = more, kth | 1 << level
                else:
                    above += n
                    rows = rows & ~slices[level]
        # what the lower bits can add is at most this much of the score over the slices: rows that near are resolved exactly
        slack = int(np.abs(query).sum()) * ((1 << self.shift) - 1) >> self.shift
        least = max(0, kth - slack)
        over, equal = np.zeros(self.words, np.uint64), within
        for level in range(max(len(slices), least.bit_length()) - 1, -1, -1):
            own = slices[level] if level < len(slices) else np.zeros(self.words, np.uint64)
            if least >> level & 1:
                equal = equal & own
            else:
                over = over | equal & own
                equal = equal & ~own
        near = np.flatnonzero(np.unpackbits((over | equal).view(np.uint8), bitorder="little"))
        scores = self.vectors[near] @ query
        ids = self.ids[near]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each row of queries its k best rows of vectors by integer inner product.

    Every row of vectors is indexed, in blocks; each block meets each chunk of queries once and gives k rows for each query at
    most, of which a window keeps the best. The result is exact. A query's own row is no candidate, other rows with its id are; ties
    go to the smaller id. Rows without an id and vectors that are null or hold null or non-finite components take no part, neither
    as queries nor as candidates; shorter vectors count as filled up with zeros; rows that repeat a query's id are queries each,
    with ranks of their own, and repeated candidates are candidates each. Empty tables give an empty result. Scores are 64-bit.

    The own row is taken out last, of k + 1 best rows: it is one with the query's id and the query's score with itself, and rows that agree
    in both look the same in the result. Repeated queries are searched for once.
    """
    candidates = staged(quantised(vectors, id_col, vector_col, scale), "vectors")
    blocks = max(1, -(-candidates.count() // block_rows))
    index = staged(_payloads(candidates.repartition(blocks), block_rows), "index")
    asked = quantised(queries, id_col, vector_col, scale).groupBy("id", "v").agg(F.count("*").alias("times"))
    asked = staged(asked.withColumn("query", F.monotonically_increasing_id()), "asked")
    chunks = staged(_payloads(asked.select("query", "v"), chunk_rows), "queries")
    chunks = chunks.select(*[F.col(c).alias(f"q_{c}") for c in chunks.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for pair in range(batch.num_rows):
                ids, vectors, dims, q_ids, q_vectors, q_dims = (c[pair].as_py() for c in batch.columns)
                if last != (ids, vectors):
                    last, block = (ids, vectors), BitSlicedIndex(*unpacked(ids, vectors, dims))
                out: list[list[np.ndarray]] = [[], [], []]
                for query_id, query in zip(*unpacked(q_ids, q_vectors, q_dims), strict=True):
                    found, scores = block.top(query, k + 1)
                    for column, values in zip(out, (np.full(len(found), query_id), found, scores), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["query", "id", "score"])

    partial = index.crossJoin(chunks).mapInArrow(run, "query long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    best = partial.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    own = asked.select("query", F.col("id").alias("query_id"), "times", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("itself"))
    best = best.join(own, "query").withColumn("is_own", (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("itself")))
    # rows from the own one on move up by one
    at = F.min(F.when(F.col("is_own"), F.col("place"))).over(Window.partitionBy("query"))
    best = best.withColumn("at", at).filter(F.col("at").isNull() | (F.col("place") != F.col("at")))
    best = best.withColumn("rank", F.when(F.col("place") > F.col("at"), F.col("place") - 1).otherwise(F.col("place"))).filter(F.col("rank") <= k)
    best = best.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: The query: rows whose vec_id is divisible by QUERY_STEP ask for their TOP best.
QUERY_STEP, TOP = 50, 5


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0), TOP)


OP4_SQL = f"""
WITH usable AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.rid <> c.rid WHERE q.vec_id % {QUERY_STEP} = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""
