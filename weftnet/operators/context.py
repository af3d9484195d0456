"""Splitting edges by the contexts of their cooccurrences."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftnet.functions.tables import dense_ids, staged
from weftnet.functions.text import STOPWORDS, WORD
from weftnet.operators.network import Network
from weftnet.sources.exports import connected_parts

Embedder = Callable[[list[str]], np.ndarray]

#: Contexts of an edge that are compared with as many others at a time, and those that a task takes together, in as many blocks as it needs.
BLOCK, TOGETHER = 1024, 2048
#: Rows of a matrix of distances, at least: smaller blocks are compared several at a time.
STRIPE = 256


def buckets(context: Column, n_features: int = 2048, stopwords: Collection[str] | None = None) -> Column:
    """Hashed bag of words: array of bucket numbers, one for each word that isn't a stop word; crc32 of the word, modulo n_features."""
    if n_features < 1:
        raise ValueError("n_features must be 1 or more")
    stop = list(STOPWORDS if stopwords is None else {w.lower() for w in stopwords})
    words = F.regexp_extract_all(F.lower(context), F.lit(f"[{WORD}]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(stop)) if stop else words
    return F.transform(kept, lambda w: (F.crc32(F.encode(w, "UTF-8")) % n_features).cast("int"))


def bag_of_words(contexts: DataFrame, n_features: int = 2048, stopwords: Collection[str] | None = None) -> DataFrame:
    """contexts (context) with bag: map of bucket to count, which is sparse however many features there are."""
    found = buckets(F.col("context"), n_features, stopwords)
    counted = F.transform(F.array_distinct("_b"), lambda b: F.struct(b.alias("key"), F.size(F.filter("_b", lambda x: x == b)).alias("value")))
    return contexts.withColumn("_b", found).withColumn("bag", F.map_from_entries(counted)).drop("_b")


def distances(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of two matrices: cosine (zero vectors: 1) or euclidean."""
    dots = left @ right.T
    own, other = np.einsum("ij,ij->i", left, left), np.einsum("ij,ij->i", right, right)
    if metric == "euclidean":
        return np.sqrt(np.clip(own[:, None] + other[None, :] - 2 * dots, 0, None))
    sizes = np.sqrt(own[:, None] * other[None, :])
    return np.clip(1 - np.divide(dots, sizes, out=np.zeros_like(dots), where=sizes > 0), 0, 2)


def dbscan(vectors: np.ndarray, eps: float, min_samples: int = 1, metric: str = "cosine", multiplicity: np.ndarray | None = None, block: int = 1024) -> np.ndarray:
    """Label of each row: clusters 0, 1, ... in order of their first rows, -1 for noise.

    A row is a core if rows of min_samples in all, itself included, lie within eps; cores within eps share a cluster, and another
    row joins that of its first core within eps. Distances are taken a block of rows at a time and never kept; multiplicity says
    how many equal rows one stands for.
    """
    if eps < 0 or min_samples < 1 or metric not in ("cosine", "euclidean"):
        raise ValueError("eps must be 0 or more, min_samples 1 or more, metric cosine or euclidean")
    n = len(vectors)
    x, times = np.asarray(vectors, np.float64), np.ones(n, np.int64) if multiplicity is None else multiplicity

    def near() -> list:
        for at in range(0, n, block):
            rows = np.arange(at, min(at + block, n))
            close = distances(x[rows], x, metric) <= eps
            close[rows - at, rows] = True
            yield rows, close

    core = np.zeros(n, bool)
    for rows, close in near():
        core[rows] = close @ times >= min_samples
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first_core = np.full(n, -1)
    for rows, close in near():
        close &= core[None, :]
        has = close.any(axis=1)
        first_core[rows[has]] = close[has].argmax(axis=1)
        for i, row in zip(rows[core[rows]].tolist(), close[core[rows]], strict=True):
            for j in np.flatnonzero(row[:i]).tolist():
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    named: dict[int, int] = {}
    labels = np.full(n, -1, np.int64)
    for i in range(n):
        if core[i] or first_core[i] >= 0:
            labels[i] = named.setdefault(root(i if core[i] else int(first_core[i])), len(named))
    return labels


class Block:
    """Vectors of some contexts of an edge: rows of (buckets, values) for bags, or dense rows."""

    def __init__(self, rows: pa.Table, sparse: bool):
        self.ids = rows.column("vid").to_numpy()
        self.times = rows.column("times").to_numpy()
        self.core = rows.column("core").to_numpy(zero_copy_only=False)
        values = rows.column("values").combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.sparse, n = sparse, len(self.ids)
        if sparse:
            self.sizes = np.diff(values.offsets.to_numpy())
            self.keys, self.values = rows.column("keys").combine_chunks().flatten().to_numpy(), flat
            self.begins = np.append(0, np.cumsum(self.sizes))
            self.own = np.bincount(np.repeat(np.arange(n), self.sizes), weights=flat**2, minlength=n)
        else:
            self.dense = flat.reshape(n, -1) if n else flat.reshape(0, 0)
            self.own = np.einsum("ij,ij->i", self.dense, self.dense)

    def matrix(self, used: np.ndarray, kind: type, a: int = 0, b: int | None = None) -> np.ndarray:
        """Rows a to b of bags over the buckets used; other buckets are left out."""
        b = len(self.ids) if b is None else b
        keys, values = self.keys[self.begins[a] : self.begins[b]], self.values[self.begins[a] : self.begins[b]]
        owner, at = np.repeat(np.arange(b - a), self.sizes[a:b]), np.searchsorted(used, keys)
        known = at < len(used)
        known[known] = used[at[known]] == keys[known]
        out = np.zeros((b - a, len(used)), kind)
        out[owner[known], at[known]] = values[known]
        return out

    def near(self, other: Block, eps: float, metric: str, same: bool, stripe: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, whether these rows' contexts lie within eps of the other's), a stripe of rows at a time.

        Bags are compared as unit vectors; the cosine distance to a zero vector is 1. Their dot products are of counts, so that they are
        exact in any order, in single precision too while they are under 2^24.
        """
        if self.sparse:
            used = np.intersect1d(self.keys, other.keys)
            kind = np.float32 if max(self.own.max(initial=0), other.own.max(initial=0)) < 1 << 24 else np.float64
            theirs = other.matrix(used, kind).T
        for at in range(0, len(self.ids), stripe):
            end = min(at + stripe, len(self.ids))
            dots = (self.matrix(used, kind, at, end) @ theirs).astype(np.float64) if self.sparse else self.dense[at:end] @ other.dense.T
            own, sizes = self.own[at:end], np.sqrt(self.own[at:end, None] * other.own[None, :])
            cosine = np.divide(dots, sizes, out=np.zeros_like(dots), where=sizes > 0)
            if metric == "cosine":
                close = np.clip(1 - cosine, 0, 2) <= eps
            else:
                a, b = ((own > 0) * 1.0, (other.own > 0) * 1.0) if self.sparse else (own, other.own)
                close = np.sqrt(np.clip(a[:, None] + b[None, :] - 2 * (cosine if self.sparse else dots), 0, None)) <= eps
            if same:
                close[np.arange(end - at), np.arange(at, end)] = True
            yield at, close


def _roots(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and column of a block pair reaches over its links."""
    a, b, none = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(close, a[:, None], none).min(axis=0, initial=none))
        new_a = np.minimum(a, np.where(close, new_b[None, :], none).min(axis=1, initial=none))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _least(links: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between ids, one for each id that reaches a lesser one: to the least."""
    if not links:
        return ids[:0], ids[:0]
    ids = np.unique(ids)
    a, b = (np.searchsorted(ids, np.concatenate([x[k] for x in links])) for k in (0, 1))
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return ids[root < np.arange(len(ids))], ids[root[root < np.arange(len(ids))]]
        root = new


class EdgeClusterer:
    """Clusters the contexts of each edge by DBSCAN.

    embed: function from texts to a matrix, run on the workers; None uses hashed bags of words, made in Spark. Equal contexts of an
    edge are embedded and compared once and count as often as they occur. An edge's contexts are dealt to groups of TOGETHER contexts, or of
    `block` if that is more, and pairs of groups are compared in tasks of their own, `block` contexts or a few such blocks at a time: they give
    counts of neighbours, then a tree of links between cores instead of all links, and the first core of every other context. Components of
    these are found in Spark. No task holds more than two groups, and each context is sent to as many tasks as its edge has groups.
    """

    def __init__(self, eps: float = 0.25, min_samples: int = 1, metric: str = "cosine", n_features: int = 2048, embed: Embedder | None = None, keep_centroids: bool = True, block: int = BLOCK):
        if metric not in ("cosine", "euclidean"):
            raise ValueError("metric is 'cosine' or 'euclidean'")
        if eps < 0 or min_samples < 1:
            raise ValueError("eps must be 0 or more, min_samples 1 or more")
        self.eps, self.min_samples, self.metric, self.n_features, self.embed, self.keep_centroids, self.block = eps, min_samples, metric, n_features, embed, keep_centroids, block

    def cluster_edge(self, network: Network, a, b) -> DataFrame:
        """Clusters of one pair; none if it has no cooccurrence."""
        return self._summary(*self._labelled(network, network.cooccurrences(a, b)))

    def cluster_edges(self, network: Network, min_weight: float = 0.0, top_k: int | None = None, pairs: Iterable[tuple] | None = None) -> DataFrame:
        """Clusters of the given pairs of entities, or else of the edges that edge_table gives: src, dst, label, size, weight, members, centroid.

        members is an array in a row; memberships() and centroids() give the same as rows, however large a cluster is.
        """
        return self._summary(*self._labelled(network, self._instances(network, min_weight, top_k, pairs)))

    def memberships(self, network: Network, min_weight: float = 0.0, top_k: int | None = None, pairs: Iterable[tuple] | None = None) -> DataFrame:
        """(src, dst, label, source, target, weight): a row for each cooccurrence of the edges; -1 is noise."""
        rows, labels = self._labelled(network, self._instances(network, min_weight, top_k, pairs))
        return self._members(rows, labels)

    def centroids(self, network: Network, min_weight: float = 0.0, top_k: int | None = None, pairs: Iterable[tuple] | None = None) -> DataFrame:
        """(src, dst, label, bucket, value): the mean of a cluster's vectors, of bags as unit vectors, where it isn't 0; a row for each bucket or dimension."""
        return self._centroid_rows(self._labelled(network, self._instances(network, min_weight, top_k, pairs))[1])

    def _instances(self, network: Network, min_weight: float, top_k: int | None, pairs: Iterable[tuple] | None) -> DataFrame:
        if pairs is None:
            edges = network.edge_table(min_weight, top_k).select("src", "dst")
        else:
            ids = sorted({tuple(sorted((network.entity(a)["entity_id"], network.entity(b)["entity_id"]))) for a, b in pairs})
            edges = network.spark.createDataFrame(ids, "src long, dst long")
        found = network.all_cooccurrences().withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})
        return found.join(edges, ["src", "dst"], "left_semi")

    def _labelled(self, network: Network, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(src, dst, key, source, target, weight) of the cooccurrences, and (src, dst, key, vid, times, keys, values, label) of their distinct contexts."""
        rows = network.with_contexts(pairs.withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")}), True)
        rows = staged(rows.select("src", "dst", F.md5("context").alias("key"), "source", "target", "weight", "context"), "instances")
        once = rows.groupBy("src", "dst", "key").agg(F.count("*").alias("times"), F.min(F.struct("source", "target")).alias("first"), F.first("context").alias("context"))
        once = self._vectors(once)
        # vid is in the order of edges, and of first cooccurrences in them
        once = dense_ids(once.select("src", "dst", "key", "times", F.col("first.source").alias("_s"), F.col("first.target").alias("_t"), "keys", "values"), ["src", "dst", "_s", "_t"], "vid")
        edges = once.groupBy("src", "dst").agg(F.count("*").alias("_n"), F.sum("times").alias("_all"))
        once = once.join(edges, ["src", "dst"]).withColumn("blocks", F.ceil(F.col("_n") / max(self.block, TOGETHER)).cast("int"))
        once = staged(once.withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")).drop("_s", "_t", "_n"), "contexts")
        labels = staged(self._labels(once), "labels")
        return rows.drop("context"), once.join(labels, "vid").select("src", "dst", "key", "vid", "times", "keys", "values", "label")

    def _vectors(self, once: DataFrame) -> DataFrame:
        """once with keys and values instead of context: buckets and counts, or no keys and what embed gives."""
        if self.embed is None:
            entries = F.array_sort(F.map_entries("bag"))
            bags = bag_of_words(once, self.n_features).withColumn("_e", entries)
            return bags.withColumns({"keys": F.transform("_e", lambda e: e["key"]), "values": F.transform("_e", lambda e: e["value"].cast("double"))}).drop("bag", "_e", "context")
        embed, names = self.embed, [c for c in once.columns if c != "context"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("context").to_pylist()
                vectors = np.asarray(embed(texts), np.float64) if texts else np.zeros((0, 0))
                columns = [*(batch.column(c) for c in names), pa.array([[]] * len(texts), pa.list_(pa.int32())), pa.array(list(vectors), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "keys", "values"])

        kinds = ", ".join(f"{c} {once.schema[c].dataType.simpleString()}" for c in names)
        return once.mapInArrow(run, f"{kinds}, keys array<int>, values array<double>")

    def _compared(self, once: DataFrame, links: bool) -> DataFrame:
        """(kind, a, b) over all pairs of groups of an edge: n, neighbours b of a; or link, a core b that core a reaches; first, a core b near a that is none."""
        partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = once.select("src", "dst", "vid", "times", "core", "keys", "values", "block", partner.alias("_p")).withColumns({"i": F.least("block", "_p"), "j": F.greatest("block", "_p")})
        eps, metric, sparse, stripe = self.eps, self.metric, self.embed is None, max(self.block, STRIPE)

        def run(table: pa.Table) -> pa.Table:
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            at = table.column("block").to_numpy()
            left = Block(table.filter(pa.array(at == i)), sparse)
            right = left if i == j else Block(table.filter(pa.array(at == j)), sparse)
            same, none = i == j, np.iinfo(np.int64).max
            mine, theirs = np.zeros(len(left.ids), np.int64), np.zeros(len(right.ids), np.int64)
            first, other_first = np.full(len(left.ids), none), np.full(len(right.ids), none)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for at, close in left.near(right, eps, metric, same, stripe):
                rows = slice(at, at + len(close))
                if not links:
                    mine[rows] = close @ right.times
                    theirs += left.times[rows] @ close
                    continue
                core = left.core[rows]
                for ids, roots in zip((left.ids[rows], right.ids), _roots(close & core[:, None] & right.core[None, :], left.ids[rows], right.ids), strict=True):
                    found.append((ids[roots < ids], roots[roots < ids]))
                if not right.core.all():
                    other_first = np.minimum(other_first, np.where(close & core[:, None], left.ids[rows, None], none).min(axis=0, initial=none))
                if not core.all():
                    first[rows] = np.where(close & right.core[None, :], right.ids[None, :], none).min(axis=1, initial=none)
            out: list[tuple[str, np.ndarray, np.ndarray]] = []
            if not links:
                out.append(("n", left.ids, mine))
                if not same:
                    out.append(("n", right.ids, theirs))
            else:
                out.append(("link", *_least(found, np.append(left.ids, right.ids))))
                for own, nearest in [(left, first)] if same else [(left, first), (right, other_first)]:
                    has = ~own.core & (nearest < none)
                    out.append(("first", own.ids[has], nearest[has]))
            kinds = np.repeat([k for k, _, _ in out], [len(a) for _, a, _ in out])
            return pa.table({"kind": pa.array(kinds.tolist(), pa.string()), "a": pa.array(np.concatenate([a for _, a, _ in out]), pa.int64()), "b": pa.array(np.concatenate([b for _, _, b in out]), pa.int64())})

        return dealt.groupBy("src", "dst", "i", "j").applyInArrow(run, "kind string, a long, b long")

    def _labels(self, once: DataFrame) -> DataFrame:
        """(vid, label): clusters of an edge count from 0 in the order of their first contexts; noise is -1."""
        alone = F.col("_all") == 1  # an edge with a single cooccurrence is a cluster whatever min_samples is
        if self.min_samples == 1:
            once = once.withColumn("core", F.lit(True))
        else:
            counts = self._compared(once.withColumn("core", F.lit(True)), False).groupBy(F.col("a").alias("vid")).agg(F.sum("b").alias("_near"))
            once = staged(once.join(counts, "vid").withColumn("core", (F.col("_near") >= self.min_samples) | alone), "cores")
        found = staged(self._compared(once, True), "links")
        parts = connected_parts(found.filter("kind = 'link'").select(F.col("a").alias("source"), F.col("b").alias("target")))
        own = once.filter("core").select("src", "dst", "vid").join(parts.select(F.col("id").alias("vid"), "part"), "vid", "left").withColumn("part", F.coalesce("part", "vid"))
        own = staged(own, "core-parts")
        first = found.filter("kind = 'first'").groupBy(F.col("a").alias("_border")).agg(F.min("b").alias("vid"))
        border = own.join(first, "vid").select("src", "dst", F.col("_border").alias("vid"), "part")
        placed = staged(own.select("src", "dst", "vid", "part").unionByName(border), "placed")
        # the order of clusters over all edges, less that of the edge's first one
        clusters = dense_ids(placed.groupBy("src", "dst", "part").agg(F.min("vid").alias("_member")), ["_member"], "_number")
        clusters = staged(clusters, "clusters")
        least = clusters.groupBy("src", "dst").agg(F.min("_number").alias("_least"))
        named = clusters.join(least, ["src", "dst"]).select("part", (F.col("_number") - F.col("_least")).alias("label"))
        return once.select("vid").join(placed.join(named, "part").select("vid", "label"), "vid", "left").select("vid", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))

    def _members(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels.select("src", "dst", "key", "label"), ["src", "dst", "key"]).select("src", "dst", "label", "source", "target", "weight")

    def _centroid_rows(self, labels: DataFrame) -> DataFrame:
        norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v)) if self.embed is None else F.lit(1.0)
        index = (lambda: F.arrays_zip("keys", "values")) if self.embed is None else (lambda: F.transform("values", lambda v, i: F.struct(i.alias("keys"), v.alias("values"))))
        each = labels.select("src", "dst", "label", "times", norm.alias("_norm"), F.explode(index()).alias("_e"))
        sizes = labels.groupBy("src", "dst", "label").agg(F.sum("times").alias("_size"))
        sums = each.groupBy("src", "dst", "label", F.col("_e.keys").alias("bucket")).agg(F.sum(F.col("_e.values") / F.col("_norm") * F.col("times")).alias("_sum"))
        return sums.join(sizes, ["src", "dst", "label"]).select("src", "dst", "label", "bucket", (F.col("_sum") / F.col("_size")).alias("value"))

    def _summary(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        member = F.struct("source", "target")
        told = self._members(rows, labels)
        found = told.groupBy("src", "dst", "label").agg(F.count("*").alias("size"), F.sum("weight").alias("weight"), F.array_sort(F.collect_list(member)).alias("members"))
        if self.embed is None or not self.keep_centroids:
            return found.withColumn("centroid", F.lit(None).cast("array<float>"))
        dense = self._centroid_rows(labels).groupBy("src", "dst", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "value"))), lambda e: e["value"].cast("float")).alias("centroid"))
        return found.join(dense, ["src", "dst", "label"], "left")
