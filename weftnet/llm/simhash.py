"""Near duplicates by SimHash with a segment-popcount embedding (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm.common import digest, discard, row_hash, staged, table, whole

#: Words of a shingle, differing bits of a link at most, and the seed of the shingles' XXH64.
WORDS, BITS, SEED = 4, 4, 42
#: Bits of a segment, each of which becomes one coordinate: the number of its bits that are set.
SEGMENT_BITS = 2
#: Fingerprints of one grid cell that are compared at a time; larger cells are compared block by block.
BLOCK = 2048
#: Fewest grid axes that must agree, by the number of fingerprints: cells stay small as it grows.
AXES = ((1_000_000, 6), (30_000_000, 7), (math.inf, 8))


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint: each bit that is set in over half the hashes."""
    totals = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # whole texts, in parts that stay in the cache
        part = hashes[at : at + 4096]
        totals += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the text's word shingles, repeats included.

    A-Z are lower-cased; words are runs of characters other than space and \\t\\n\\v\\f\\r; a text of fewer words has its whole
    sequence as the one shingle; a text of none, and null, has the fingerprint 0.
    """
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(tokens) - words)
    spans = zip(starts[: last + 1].tolist(), ends[min(words, len(tokens)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return bits_of(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, last + 1))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(key_col, fp): fp holds the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key_col, "fp"])

    kind = docs.schema[key_col].dataType.simpleString()
    return docs.select(key_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{key_col}` {kind}, fp long")


def cell_keys(fp: Column, groups: int, bits: int = BITS, segment_bits: int = SEGMENT_BITS) -> Column:
    """Array of the grid cells of a fingerprint.

    The embedding counts the set bits of each segment; the Manhattan distance of two embeddings is at most the Hamming
    distance of the fingerprints. Its coordinates are dealt to `groups` grid axes. Two embeddings at a distance of `bits` or
    less differ on at most `bits` axes, so that they agree exactly on some choice of groups - bits axes: a cell for each choice.
    """
    segments = 64 // segment_bits
    counts = [F.bit_count(F.shiftrightunsigned(fp, segment_bits * i).bitwiseAND(F.lit((1 << segment_bits) - 1))).cast("long") for i in range(segments)]
    axes = []
    for g in range(groups):
        own = counts[segments * g // groups : segments * (g + 1) // groups]
        axis = own[0]
        for c in own[1:]:
            axis = axis * F.lit(segment_bits + 1) + c
        axes.append(axis)
    return F.array(*[F.xxhash64(F.lit(i), *[axes[g] for g in chosen]) for i, chosen in enumerate(combinations(range(groups), groups - bits))])


class Forest:
    """Union-find over fingerprints met in one task; joins() keeps only the links that connect something new."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def joins(self, links: np.ndarray) -> list[tuple[int, int]]:
        kept = []
        for a, b in links.tolist():
            x, y = self.find(a), self.find(b)
            if x != y:
                self.parent[x] = y
                kept.append((a, b))
        return kept


def embedded(fps: np.ndarray) -> np.ndarray:
    """The popcounts of the SEGMENT_BITS = 2 bit segments, each as that many low bits of its segment.

    So written, the Manhattan distance of two embeddings is the number of bits in which they differ.
    """
    low = np.uint64(0x5555555555555555)
    return ((fps & (fps >> np.uint64(1)) & low) << np.uint64(1)) | ((fps | (fps >> np.uint64(1))) & low)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether pairs of fingerprints at an embedded Manhattan distance of `bits` or less, which bounds it from below, are that near exactly."""
    return np.bitwise_count(a ^ b) <= bits


def _close(left: np.ndarray, right: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Links between two sets of fingerprints of one cell, some rows of the comparison at a time: by Manhattan distance, then exactly."""
    placed = embedded(right)
    for at in range(0, len(left), 256):
        a = left[at : at + 256]
        i, j = np.nonzero(np.bitwise_count(embedded(a)[:, None] ^ placed[None, :]) <= bits)
        x, y = a[i], right[j]
        kept = _near(x, y, bits) & (x != y)
        if kept.any():
            yield np.stack([x[kept], y[kept]], axis=1)


def _compare(cells: DataFrame, bits: int) -> DataFrame:
    """(cell, left, right, side, fp), all rows of (cell, left, right) in one partition and sorted -> spanning links (a, b) of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[np.ndarray] = []

        def linked(rows: np.ndarray) -> list[tuple[int, int]]:
            """Links within each run of equal (cell, left, right) of rows: columns cell, left, right, side, fp."""
            found = []
            same = (rows[1:, :3] == rows[:-1, :3]).all(axis=1)
            edges = np.flatnonzero(np.concatenate(([True], ~same, [True])))
            lengths = np.diff(edges)
            fps = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
            placed = embedded(fps)
            run_of = np.repeat(np.arange(len(lengths)), lengths)
            small = (lengths <= 64) & (rows[edges[:-1], 1] == rows[edges[:-1], 2])
            at = np.flatnonzero(small[run_of])
            for step in range(1, 64):  # all pairs of the small runs, by their distance in the sort order
                at = at[at + step < len(rows)]
                at = at[run_of[at] == run_of[at + step]]
                if not len(at):
                    break
                near = at[np.bitwise_count(placed[at] ^ placed[at + step]) <= bits]
                near = near[_near(fps[near], fps[near + step], bits) & (fps[near] != fps[near + step])]
                found += forest.joins(np.stack([fps[near], fps[near + step]], axis=1))
            for r in np.flatnonzero(~small & (lengths > 1)).tolist():
                own, part = rows[edges[r] : edges[r + 1]], fps[edges[r] : edges[r + 1]]
                sides = (part, part) if own[0, 1] == own[0, 2] else (part[own[:, 3] == 0], part[own[:, 3] == 1])
                for links in _close(*sides, bits):
                    found += forest.joins(links)
            return found

        def rows_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64)
            held.append(rows)
            rows = np.concatenate(held)
            # the last run may go on in the next batch
            last = len(rows) - 1
            ends = np.flatnonzero((rows[:, :3] != rows[last, :3]).any(axis=1))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield rows_of(linked(rows[:cut]))
            held = [rows[cut:]]
        if held and len(held[0]):
            yield rows_of(linked(held[0]))

    return cells.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect the same fingerprints as all pairs at `bits` or fewer differing bits.

    Grid range-join: fingerprints that may be within the Manhattan distance share a cell of cell_keys, and each pair of a cell is
    checked on its 64 bits. Tasks give back only links that join something new, so that a large group gives about as many links
    as it has members, not all its pairs. A cell with more than `block` fingerprints is cut into blocks by hash, and each pair of
    blocks is compared by itself, so that a task holds two blocks at most however large a cell grows.
    """
    fps = staged(fps, "fingerprints")
    n = fps.count()
    groups = groups or next(g for most, g in AXES if n <= most)
    cells = fps.select("fp", F.explode(cell_keys(F.col("fp"), groups, bits)).alias("cell"))
    large = cells.groupBy("cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    large = staged(large.select("cell", F.ceil(2 * F.col("_n") / block).cast("int").alias("_blocks")), "large-cells")
    # at most members / block cells are large
    few = large.count() <= 100_000
    told = cells.join(F.broadcast(large) if few else large, "cell", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("_blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("_blocks") - 1)
    told = told.withColumn("_mine", mine).withColumn("_other", F.explode(other))
    told = told.select("cell", F.least("_mine", "_other").alias("left"), F.greatest("_mine", "_other").alias("right"), (F.col("_mine") > F.col("_other")).cast("int").alias("side"), "fp")
    dealt = told.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right", "side", "fp")
    return _compare(dealt.select(*[F.col(c).cast("long").alias(c) for c in ("cell", "left", "right", "side", "fp")]), bits)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) of nodes -> (node, root) for every linked node but the roots: root is the smallest node that can be reached.

    Alternates two steps until nothing changes: each node's larger neighbours are linked to its smallest neighbour, then each
    node's smaller neighbours are. Every round is a group-by and a written table; a node with very many links meets its
    minimum in partial aggregation first, and its links are joined to that minimum by a join that Spark can split.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        low = larger.groupBy("b").agg(F.min("a").alias("m"))
        smaller = larger.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        before, edges = edges, staged(smaller, "links")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def groups(marked: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, ...) -> (fp, root, component_id) for each fingerprint.

    root is the least fingerprint of the component, component_id the least doc_id among its documents (null if all are null).
    Equal fingerprints are one node, so that copies are never paired.
    """
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("_least")), "nodes")
    roots = components(links(nodes.select("fp"), bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "_least")
    rooted = staged(rooted, "roots")
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("_least").alias("component_id")), "root")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    Fingerprints are linked at `bits` or fewer differing bits. Null and empty texts share the fingerprint 0, which is linked
    like any other. Repeated rows each get a row; a null doc_id gets a row and takes part, but is a component's id only where
    nothing else is in it; an empty table gives an empty result; other columns of docs are left out.
    """
    marked = staged(fingerprints(docs.select("doc_id", "text"), words, seed), "marked")
    result = marked.join(groups(marked, bits).select("fp", "component_id"), "fp")
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """docs with one row of each component of near duplicates: that of least doc_id (nulls last), then of least digest of its text.

    Rows equal in doc_id and text are one document, of which one row stays.
    """
    key = digest(F.col("doc_id"), F.col("text"))
    marked = staged(fingerprints(docs.select(F.struct("doc_id", key.alias("key")).alias("_row"), "text"), words, seed, key_col="_row"), "marked")
    marked = marked.select("_row.doc_id", F.col("_row.key").alias("_key"), "fp")
    rooted = marked.join(groups(marked.select("doc_id", "fp"), bits).select("fp", "root"), "fp")
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_weft_key"))
    rows = docs.select(key.alias("_weft_key"), whole(docs).alias("_row"), row_hash(docs).alias("_order")).join(kept.select("_weft_key"), "_weft_key", "left_semi")
    return rows.groupBy("_weft_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
