"""Clusters around centroids, with distance bounds that moving centroids loosen by less than their drift (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm.common import ddl, discard, staged, table, whole

#: Steps of a component: x becomes floor(STEPS * x).
STEPS = 1024

STATE = "kind int, v binary, cluster int, upper double, lower double, distance long, change array<bigint>, radius array<double>"
#: A rounding error can't be larger than this share of a bound.
_SLACK = 1e-9


@dataclass
class Moved:
    """What a round needs to know of the centroids: where they are, how far each went, and how far bounds are loosened."""

    centroids: np.ndarray
    drift: np.ndarray
    loosened: np.ndarray
    half: np.ndarray


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster i, the most that the distance of a vector of it to any other centroid can have become smaller.

    The vectors of i lie in the sphere of radius[i] around old[i]. As the distance to a point that moves on a line is convex in the
    way it has gone, centroid j comes closer to x by at most |drift| cos(phi), phi being the angle at old[j] between its drift and x.
    In the plane through old[j], its new place and old[i], the sphere is seen from old[j] under the angle asin(radius / distance) around old[i], which
    leaves phi no smaller than the angle to old[i] less that. The full drift is the bound only for a centroid that heads for the
    sphere, or is inside it; one that leaves makes the bound negative: the vectors' lower bounds rise.
    """
    k = len(old)
    out = np.full(k, -np.inf)
    for i in range(k):
        for j in range(k):
            if i == j:
                continue
            step, away = new[j] - old[j], old[i] - old[j]
            size, gap = np.sqrt(step @ step), np.sqrt(away @ away)
            closer = size
            if size == 0:
                closer = 0.0
            elif gap > radius[i] * (1 + _SLACK):
                angle = np.arccos(np.clip(step @ away / (size * gap), -1, 1)) - np.arcsin(radius[i] / gap)
                closer = size * np.cos(max(0.0, angle)) + _SLACK * size
            out[i] = max(out[i], closer)
    return np.where(np.isinf(out), 0.0, out)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to its nearest other one: vectors nearer than that can't belong elsewhere."""
    gaps = squared(centroids, centroids).astype(np.float64)
    np.fill_diagonal(gaps, np.inf)
    return np.sqrt(gaps.min(axis=1)) / 2


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to centroids, as integers."""
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:  # then sums of floats are exact
        a, b = x.astype(np.float64), centroids.astype(np.float64)
    elif 4 * x.shape[1] * most * most < 2**63:
        a, b = x.astype(np.int64), centroids.astype(np.int64)
    else:
        raise ValueError(f"components of {most:.0f} steps are too large: squared distances don't fit 64 bits")
    return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None, :]).astype(np.int64)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower) after the centroids have moved, and how many vectors were compared with all centroids.

    upper bounds the distance to the own centroid, lower that to every other one. A vector whose bounds, loosened, still
    tell the two apart keeps its cluster; for the others the own distance is taken exactly, and if that doesn't settle it, all are. Cluster -1
    is none yet.
    """
    cluster = cluster.copy()
    held = cluster >= 0
    own = np.where(held, cluster, 0)
    upper = np.where(held, upper + moved.drift[own], np.inf)
    lower = np.where(held, lower - moved.loosened[own], 0.0)
    limit = np.maximum(lower, moved.half[own])

    def open_(rows: np.ndarray) -> np.ndarray:
        return rows[~(upper[rows] * (1 + _SLACK) + _SLACK < limit[rows])]

    rows = open_(np.arange(len(x)))
    near = rows[held[rows]]
    for c in np.unique(cluster[near]):
        at = near[cluster[near] == c]
        upper[at] = np.sqrt(squared(x[at], moved.centroids[c : c + 1])[:, 0])
    rows = open_(rows)
    if len(rows):
        d = squared(x[rows], moved.centroids)
        cluster[rows] = d.argmin(axis=1)  # the first of equal ones
        least = np.arange(len(rows)), cluster[rows]
        upper[rows] = np.sqrt(d[least])
        rest = d.astype(np.float64)
        rest[least] = np.inf
        lower[rows] = np.sqrt(rest.min(axis=1))
    return cluster, upper, lower, len(rows)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims)


def _whole_steps(vectors: DataFrame, vector_col: str, dims: int) -> DataFrame:
    """(_row, v): the rows whose vector is whole, with its components in steps; _row has the other columns."""
    names = [c for c in vectors.columns if c != vector_col]
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(v.isNotNull() & good).select(whole(vectors, names).alias("_row"), v.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(STEPS * batch.column(1).flatten().to_numpy().reshape(-1, dims))
            if (most := float(np.abs(x).max(initial=0))) >= 2**31:
                raise ValueError(f"components of {most:.3g} steps are too large: squared distances don't fit 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())], names=["_row", "v"])

    return rows.mapInArrow(run, f"{ddl(rows, ['_row'])}, v binary")


def _assigned(state: DataFrame, moved: Moved, dims: int) -> DataFrame:
    """The state after a round; each task adds one row (kind 1) of what changed in it.

    change: for each cluster the sums of components and the number of vectors that came, less those that left; then the vectors compared with all
    centroids. radius: for each cluster its largest upper bound.
    """
    k = len(moved.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, radius, compared, kind = np.zeros((k, dims + 1), np.int64), np.zeros(k), 0, None
        for batch in batches:
            kind = batch.column(0).type
            n = batch.num_rows
            if not n:
                continue
            x = _vectors(batch.column(1), dims)
            before = batch.column(2).to_numpy()
            cluster, upper, lower, scanned = assign(x, before, batch.column(3).to_numpy(), batch.column(4).to_numpy(), moved)
            compared += scanned
            rows = np.flatnonzero(cluster != before)
            came = np.concatenate([x[rows].astype(np.int64), np.ones((len(rows), 1), np.int64)], axis=1)
            np.add.at(change, cluster[rows], came)
            left = before[rows] >= 0
            np.add.at(change, before[rows][left], -came[left])
            np.maximum.at(radius, cluster, upper)
            distance = np.empty(n, np.int64)
            for c in np.unique(cluster):
                at = np.flatnonzero(cluster == c)
                distance[at] = squared(x[at], moved.centroids[c : c + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(n, np.int32)), batch.column(1), *map(pa.array, (cluster, upper, lower, distance)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.float64()))], names=names)
        if kind is not None:
            empty = [pa.nulls(1, t) for t in (pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([1], pa.int32()), *empty, pa.array([[*change.ravel().tolist(), compared]], pa.list_(pa.int64())), pa.array([radius.tolist()], pa.list_(pa.float64()))], names=names)

    names = ["_row", *(c.split()[0] for c in STATE.split(", "))]
    return state.filter("kind = 0").select("_row", "v", "cluster", "upper", "lower").mapInArrow(run, f"{ddl(state, ['_row'])}, {STATE}")


def _totals(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(changes of sums and counts, radii, vectors compared with all) over the tasks' rows, added up in Spark: k * (dims + 1) + 1 rows."""
    own = state.filter("kind = 1")
    change, radius = [0] * (k * (dims + 1) + 1), np.zeros(k)
    for r in own.select(F.posexplode("change").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        change[r["i"]] = r["x"]
    for r in own.select(F.posexplode("radius").alias("i", "x")).groupBy("i").agg(F.max("x").alias("x")).collect():
        radius[r["i"]] = r["x"]
    return np.array(change[:-1], np.int64).reshape(k, dims + 1), radius, change[-1]


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, compared: list[int] | None = None) -> DataFrame:
    """The whole vectors' rows, without vector_col, with cluster (int), distance, cluster_inertia, inertia (long) and centroid_sha256.

    Vectors of exactly dims components, none null or not finite, are taken, as whole steps floor(1024 * x); others are left out. The first
    centroids are those of the smallest digests of seed and id; each round assigns every vector to the nearest centroid (ties: the
    smaller number) and moves every centroid with vectors to the floor of their mean; a last assignment follows. distance is squared.

    Each round is one pass over a table of vectors with their bounds, written anew; the driver gets k * (dims + 2) numbers of it.
    Sums change by the vectors that moved only. `compared`, if given, gets each pass's number of vectors compared with all
    centroids. Repeated rows are vectors of their own (one of equal ids and vectors each is a first centroid of its own); a null id has
    the digest of the empty string; fewer than k vectors make as many centroids; no vector gives no row; columns named as the
    added ones are replaced. Components of 2^26 steps or so, whose squared distance doesn't fit 64 bits, are a ValueError.
    """
    added = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    names = [c for c in vectors.columns if c not in added]
    steps = _whole_steps(vectors.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names]), vector_col, dims)
    begun = steps.select("_row", F.lit(0).alias("kind"), "v", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance"), F.lit(None).cast("array<bigint>").alias("change"), F.lit(None).cast("array<double>").alias("radius"))
    state = staged(begun, "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"_row.`{id_col}`").cast("string"), F.lit(""))), 256)
    first = [r["v"] for r in state.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    if not first:
        kinds = ["int", "long", "long", "long", "string"]
        return state.select("_row.*", *[F.lit(None).cast(t).alias(c) for c, t in zip(added, kinds, strict=True)]).limit(0)
    centroids = np.array([np.frombuffer(v, np.int32) for v in first], np.int64)
    k = len(centroids)
    sums, moved = np.zeros((k, dims + 1), np.int64), Moved(centroids, np.zeros(k), np.zeros(k), half_gaps(centroids))
    for at in range(rounds + 1):
        after = staged(_assigned(state, moved, dims), "assigned")
        discard(state)
        state = after
        change, radius, n = _totals(state, k, dims)
        if compared is not None:
            compared.append(n)
        sums += change
        if at < rounds:
            some = sums[:, -1] > 0
            new = np.where(some[:, None], sums[:, :-1] // np.maximum(sums[:, -1:], 1), centroids)
            a, b = centroids.astype(np.float64), new.astype(np.float64)
            moved = Moved(new, np.sqrt(((b - a) ** 2).sum(axis=1)), loosening(a, b, radius), half_gaps(new))
            centroids = new
    spark = vectors.sparkSession
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    inertia = state.filter("kind = 0").groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    every = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in inertia)) for r in inertia], "cluster int, cluster_inertia long, inertia long")
    # k rows
    told = state.filter("kind = 0").select("_row", "cluster", "distance").join(F.broadcast(every.join(digests, "cluster")), "cluster")
    return told.select("_row.*", *added)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_sql(rounds: int = 10, k: int = 8) -> str:
    """The rounds as one table after another."""
    parts = [
        "x AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * c::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, v AS m FROM x ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    nearest = "SELECT id, min({{'d': list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c}}) AS n FROM x, c{0} GROUP BY id"
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        parts.append(f"s{i} AS (SELECT c, p, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS y FROM (SELECT n.c AS c, unnest(v) AS y, generate_subscripts(v, 1) AS p FROM a{i} JOIN x USING (id)) GROUP BY c, p)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c AS c, coalesce(f.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(y ORDER BY p) AS m FROM s{i} GROUP BY c) f ON f.c = o.c)")
    parts.append(f"a AS MATERIALIZED (SELECT vec_id, n.c AS c, CAST(n.d AS BIGINT) AS d FROM ({nearest.format(rounds)}) JOIN x USING (id))")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"\nSELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a JOIN c{rounds} z ON z.c = a.c"
    )
