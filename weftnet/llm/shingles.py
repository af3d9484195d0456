"""Near copies by exact similarity of word shingles: SimHash links first, then what these miss (the pipeline's near-duplicate stage)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftnet.llm.common import digest, discard, row_hash, staged, whole
from weftnet.llm.simhash import BITS, bits_of, components, links

#: Words of a shingle, and the least similarity |x & y| / |x | y| of two texts' sets of shingles, as a fraction.
WORDS, SHARE = 5, (4, 5)
#: Seed of the shingles' XXH64.
SEED = 42
#: Share of all hashes, the lowest, of which each text is told whether another text has them too.
LOW = 0.3
#: Texts looked at for frequent shingles, the share of them that makes one, and how many are told to the tasks at most.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 0.001, 20_000
#: Members of a cell that stand in one order at a time.
BLOCK = 512
#: Longs of a set's parity bitmap.
SIGNS = tuple(f"sign{i}" for i in range(4))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; words, case and short texts as in simhash.fingerprint, no word: no shingle."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    return np.unique(np.fromiter((hashed(b" ".join(tokens[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def least_shared(size: int | Column, share: tuple[int, int] = SHARE) -> int | Column:
    """Shingles of a set that a similar one has at least; all but so many, and one more, are its prefix."""
    return -(-share[0] * size // share[1]) if isinstance(size, int) else F.ceil(size * share[0] / share[1])


def low_part(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set's shingles among the lowest hashes, without those that are known to be frequent."""
    low = own[: np.searchsorted(own, np.uint64(int(LOW * 2**64)))]
    return low[~np.isin(low, frequent)]


def prefix(own: np.ndarray, common: np.ndarray, frequent: np.ndarray, share: tuple[int, int] = SHARE) -> tuple[int, np.ndarray]:
    """The first of a set's shingles in an order that is the same for all sets: two similar sets share one of them.

    First come the low ones that no other set has (`common` are the low ones that others have), then all others, then frequent
    ones, each by hash. The first kind meets nothing: only their number is given, and what follows them in the prefix.
    """
    low = low_part(own, frequent)
    alone = low[~np.isin(low, common)]
    rest = own[~np.isin(own, alone)]
    last = np.isin(rest, frequent)
    n = len(own) - least_shared(len(own), share) + 1
    return min(n, len(alone)), np.concatenate((rest[~last], rest[last]))[: max(0, n - len(alone))]


def parity_bitmap(own: np.ndarray) -> np.ndarray:
    """Bits as 64-bit integers: a shingle turns over the bit that its hash names.

    Two sets' bitmaps differ in no more bits than the sets do in shingles, as what both have turns over the same bits in both.
    """
    width = 64 * len(SIGNS)
    odd = np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of many texts, by a sample: only their place in the order depends on it."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["h"])

    share = min(1.0, SAMPLE / max(1, n))
    part = docs.filter(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    least = max(16, int(FREQUENT * min(n, SAMPLE)))
    counts = part.select(F.col("text").cast("string")).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r.h for r in rows], np.int64)).view(np.uint64)


def _sets(docs: DataFrame, words: int, frequent: np.ndarray) -> DataFrame:
    """(_key, text) -> (_key, id, size, fp, low): id names the set of shingles (0 that of no word), so equal sets are one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, sizes, fps, ends, parts = [], [], [], [0], [np.zeros(0, np.uint64)]
            for t in batch.column(1):
                own = shingle_set(t.as_py(), words)
                ids.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0)
                sizes.append(len(own))
                fps.append(bits_of(own))
                parts.append(low_part(own, frequent))
                ends.append(ends[-1] + len(parts[-1]))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), listed], names=["_key", "id", "size", "fp", "low"])

    return docs.select("_key", F.col("text").cast("string").alias("text")).mapInArrow(run, "_key binary, id long, size int, fp long, low array<long>")


def _prefixes(texts: DataFrame, words: int, frequent: np.ndarray, share: tuple[int, int]) -> DataFrame:
    """(id, common, text) -> (id, size, SIGNS, alone, at, h): the shingles of the prefix that other sets may have, with their places in the set's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, common, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = shingle_set(text.as_py(), words)
                alone, rest = prefix(own, np.array(common.as_py() or [], np.int64).view(np.uint64), frequent, share)
                n = len(rest)
                signs = [np.full(n, s, np.int64) for s in parity_bitmap(own)]
                columns = [np.full(n, name, np.int64), np.full(n, len(own), np.int32), *signs, np.full(n, alone, np.int32), np.arange(alone, alone + n, dtype=np.int32), rest.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "size", *SIGNS, "alone", "at", "h"])

    return texts.select("id", "common", "text").mapInArrow(run, f"id long, size int, {', '.join(f'{s} long' for s in SIGNS)}, alone int, at int, h long")


def _enough(overlap: Column, share: tuple[int, int]) -> Column:
    """Whether sets of sizes a_size and b_size can be similar if they share `overlap` shingles at most."""
    return overlap * (share[0] + share[1]) >= (F.col("a_size") + F.col("b_size")) * share[0]


def _alike(share: tuple[int, int]) -> Column:
    """Whether sets of sizes a_size and b_size can be similar by the bits in which their parity bitmaps differ."""
    apart = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SIGNS[1:]), F.bit_count(F.col(f"a_{SIGNS[0]}").bitwiseXOR(F.col(f"b_{SIGNS[0]}"))))
    return apart * (share[0] + share[1]) <= (F.col("a_size") + F.col("b_size")) * (share[1] - share[0])


def _verified(pairs: DataFrame, texts: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar; texts: (id, text), a row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            kept = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a not in sets:  # pairs are sorted by a
                    sets = {a: shingle_set(x.as_py(), words)}
                own, other = sets[a], shingle_set(y.as_py(), words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both * share[1] >= (len(own) + len(other) - both) * share[0]:
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in kept], pa.int64()), pa.array([p[1] for p in kept], pa.int64())], names=["a", "b"])

    met = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    met = met.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    return met.sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(_key, text) -> (_key, id) and (node, root): the links of all texts at a similarity of `share` or more, to their components.

    First the SimHash join of op3: sets whose fingerprints are within `bits` are verified by their exact similarity. At this
    similarity some fingerprints are farther apart, so there are prefixes too: two similar sets share a shingle of their
    prefixes (see prefix), so no pair is lost. Most texts have so many shingles of their own that their prefix meets nothing:
    they are done after one exchange of their low hashes. Cells are the others by shingle of the prefix. With the SimHash pairs,
    each set of a cell is compared with a neighbour and with the cell's hub, so that a large group of near copies gives about as
    many pairs as it has members; what is still apart in a cell is then paired. A pair is verified on the texts if its shared shingles, and what may follow the last of
    them, can be enough, and if its parity bitmaps differ in no more bits than similar sets do in shingles. Intermediate tables are deleted.
    """
    frequent = _frequent(docs, words)
    marked = staged(_sets(docs, words, frequent), "sets")
    nodes = staged(marked.groupBy("id").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.min("_key").alias("_key"), F.max(F.size("low")).alias("n_low")), "nodes")
    source = docs.select("_key", F.col("text").cast("string").alias("text"))

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, ...) -> the same with text, of one document of each set."""
        told = staged(nodes.select("id", "_key").join(ids, "id"), "wanted")
        return source.join(told, "_key").groupBy("id").agg(*[F.first(c).alias(c) for c in (*[c for c in ids.columns if c != "id"], "text")])

    def verified(pairs: DataFrame) -> DataFrame:
        told = staged(pairs, "candidates")
        texts = staged(texts_of(told.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "texts")
        found = staged(_verified(told, texts, words, share), "near")
        discard(told, texts)
        return found

    # sets of one fingerprint meet at the least of them, and so do those of linked fingerprints
    by_fp = staged(nodes.filter("size > 0").groupBy("fp").agg(F.min("id").alias("_first")), "by-fingerprint")
    same = nodes.filter("size > 0").join(by_fp, "fp").filter("id <> _first").select(F.col("_first").alias("a"), F.col("id").alias("b"))
    joined = links(by_fp.select("fp"), bits).join(by_fp.select(F.col("fp").alias("a"), F.col("_first").alias("_a")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("_first").alias("_b")), "b")
    by_bits = same.unionByName(joined.select(F.col("_a").alias("a"), F.col("_b").alias("b")))

    low = marked.select("id", F.explode("low").alias("h"))
    by_hash = Window.partitionBy("h")
    common = low.withColumns({"_min": F.min("id").over(by_hash), "_max": F.max("id").over(by_hash)}).filter("_min < _max").select("id", "h").distinct()
    common = staged(common.groupBy("id").agg(F.collect_list("h").alias("common")), "common")
    alone = F.col("n_low") - F.coalesce(F.size("common"), F.lit(0))
    told = nodes.join(common, "id", "left").filter((F.col("size") > 0) & (alone < F.col("size") - least_shared(F.col("size"), share) + 1))
    listed = staged(_prefixes(texts_of(told.select("id", "common")), words, frequent, share), "prefixes")
    # the hub of a cell is the set with the fewest shingles of its own: the text that the others were made from, if there is one
    hub = F.min(F.struct("alone", "id", "size", "at", *SIGNS))
    shared = listed.groupBy("h").agg(F.count("*").alias("n"), hub.alias("hub")).filter("n > 1")
    cells = staged(listed.join(shared, "h").select("h", "id", "size", *SIGNS, "alone", "at", "n", "hub"), "cells")
    discard(common, listed)

    # of what stands before a shared place the shingles that a set has alone can't be shared, nor more behind it than the shorter rest
    most = F.least(F.col("a_at") - F.col("a_alone"), F.col("b_at") - F.col("b_alone")) + F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    possible = _enough(most, share) & _alike(share)

    def near(rows: DataFrame) -> DataFrame:
        """Pairs a, b of rows that hold a_ and b_ columns of one cell, if they can be similar."""
        return rows.filter((F.col("a_id") != F.col("b_id")) & possible).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))

    columns = ("id", "size", *SIGNS, "alone", "at")
    block = F.pmod(F.xxhash64(F.lit(10), "id"), F.ceil(F.col("n") / BLOCK))
    line = Window.partitionBy("h", "_block").orderBy(F.xxhash64(F.lit(0), "id"), "id")
    own = [F.col(c).alias(f"a_{c}") for c in columns]
    beside = cells.withColumn("_block", block).select(*own, *[F.lag(c).over(line).alias(f"b_{c}") for c in columns]).filter("b_id is not null")
    to_hub = cells.select(*own, *[F.col(f"hub.{c}").alias(f"b_{c}") for c in columns])
    by_bits = by_bits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = verified(by_bits.unionByName(near(beside)).unionByName(near(to_hub)).distinct())
    roots = components(found)

    rooted = cells.join(roots, cells["id"] == roots["node"], "left").select("h", *columns, F.coalesce("root", "id").alias("root"))
    open_cells = rooted.groupBy("h").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("h")
    apart = staged(rooted.join(open_cells, "h", "left_semi"), "apart")
    one, other = (apart.select("h", *[F.col(c).alias(f"{side}_{c}") for c in (*columns, "root")]) for side in "ab")
    both = one.join(other, "h").filter((F.col("a_id") < F.col("b_id")) & (F.col("a_root") != F.col("b_root")) & possible)
    # all that a pair shares up to the last place that its prefixes share has been met
    met = both.groupBy(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_size", "b_size").agg(F.count("*").alias("_n"), F.max("a_at").alias("_i"), F.max("b_at").alias("_j"))
    most = F.col("_n") + F.least(F.col("a_size") - F.col("_i"), F.col("b_size") - F.col("_j")) - 1
    more = verified(met.filter(_enough(most, share)).select("a", "b"))
    discard(apart)
    if not more.isEmpty():
        found = found.unionByName(more)
        roots = components(found)
    discard(nodes, by_fp, cells, found)
    return marked.select("_key", "id"), roots


def keep_one(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """docs with one row of each component of near copies: that of least doc_id (nulls last), then of least digest of its text.

    Rows equal in doc_id and text are one document, of which one row stays; texts without a word are one component.
    """
    key = digest(F.col("doc_id"), F.col("text"))
    own, roots = similar_groups(docs.select(key.alias("_key"), "text"), words, share)
    rooted = own.join(roots, own["id"] == roots["node"], "left").select("_key", F.coalesce("root", "id").alias("root"))
    named = docs.select("doc_id", key.alias("_key")).join(rooted.distinct(), "_key")
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_weft_key"))
    rows = docs.select(key.alias("_weft_key"), whole(docs).alias("_row"), row_hash(docs).alias("_order")).join(kept.select("_weft_key"), "_weft_key", "left_semi")
    return rows.groupBy("_weft_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
