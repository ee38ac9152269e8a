"""Clusters of whole-number vectors by Lloyd rounds that do only what the last round made necessary.

Assignments and the global sums of clusters are tables in the shared folder.  A vector whose own centroid stood still is
held against the centroids that moved, as it lies nearer to its own than to any other that stood still; a vector whose own
centroid moved is held against all.  What vectors that change clusters take along is summed as signed whole numbers, a few
rows a task, and added to the sums of the round before.  All numbers are exact, so the result is that of full rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

DIMS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2:"
#: Components beyond this size are refused: a long would not hold their squared distances.
LARGEST = 1 << 27
#: Rows whose distances are computed at once.
AT_ONCE = 4096
STATE = "vec_id long, v array<int>, cluster int, distance long, before int"


@dataclass
class Clustering:
    """vec_id, cluster and distance of every vector, and the final centroids (at most ``k`` rows of whole numbers)."""

    assigned: DataFrame
    centroids: np.ndarray


def whole_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (ints: floor(scale * x)) of the rows of (vec_id, embedding) with exactly ``dims`` finite components.

    Vectors with a component of 2**27 or more after scaling are left out as well, as no long holds their distances."""
    x = F.col("embedding").cast("array<double>")
    scaled = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e))

    def sound(e: Column) -> Column:
        return e.isNotNull() & ~F.isnan(e) & (F.abs(F.lit(float(scale)) * e) < LARGEST)

    found = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), scaled.cast("array<int>").alias("v"))
    return found.filter((F.size("x") == dims) & F.coalesce(F.forall("x", sound), F.lit(False))).select("vec_id", "v")


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The ``k`` vectors (fewer, if there are fewer) with the smallest sha256 of salt and id, ties by the vector."""
    named = vectors.select("v", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256).alias("h"))
    rows = named.orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two arrays of longs."""
    if not len(v) or not len(c):
        return np.zeros((len(v), len(c)), np.int64)
    most = max(int(np.abs(v).max()), int(np.abs(c).max()))
    if 4 * most * most * v.shape[1] < 1 << 53:
        one, two = v.astype(np.float64), c.astype(np.float64)
        return ((one * one).sum(1)[:, None] - 2 * (one @ two.T) + (two * two).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], axis=1)


def reassign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) after some centroids moved; an owner of -1 is none yet.  Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    anew = (owner < 0) | moved[owner]
    if anew.any():
        d = squared(v[anew], centroids)
        owner[anew] = d.argmin(1)
        distance[anew] = d.min(1)
    some, still = np.flatnonzero(moved), np.flatnonzero(~anew)
    if len(some) and len(still):
        d = squared(v[still], centroids[some])
        nearest, least = some[d.argmin(1)], d.min(1)
        won = (least < distance[still]) | ((least == distance[still]) & (nearest < owner[still]))
        owner[still[won]], distance[still[won]] = nearest[won], least[won]
    return owner, distance


def _rows(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigner(centroids: np.ndarray, moved: np.ndarray):
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(a, AT_ONCE)
                before = batch.column(2).to_numpy().astype(np.int64)
                owner, distance = reassign(_rows(batch.column(1), dims), before, batch.column(3).to_numpy(), centroids, moved)
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(owner.astype(np.int32)), pa.array(distance), pa.array(before.astype(np.int32))],
                    ["vec_id", "v", "cluster", "distance", "before"],
                )

    return run


def _transfers(k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            v = np.column_stack([_rows(batch.column(0), dims), np.ones(batch.num_rows, np.int64)])
            to, away = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            np.add.at(total, to, v)
            np.subtract.at(total, away[away >= 0], v[away >= 0])
        cluster, at = np.nonzero(total)
        yield pa.record_batch([pa.array(cluster.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[cluster, at])], ["cluster", "at", "delta"])

    return run


def transfers(state: DataFrame, k: int, dims: int) -> DataFrame:
    """(cluster, at, delta): by how much the sums of each cluster change; place ``dims`` holds its count."""
    moved = state.filter("cluster <> before").select("v", "cluster", "before")
    return moved.mapInArrow(_transfers(k, dims), "cluster int, at int, delta long").select("cluster", "at", F.col("delta").cast("decimal(38,0)").alias("delta"))


def delta_lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> Clustering:
    """Assign (vec_id, v) to the nearest of ``k`` centroids and replace these by their vectors' floored means, ``rounds``
    times, then assign once more.

    Every row is a vector of its own, even if its id or components are another's.  With fewer vectors than ``k`` each is a
    centroid; an empty table has none and gives an empty result.  Null ids are kept and hash as an empty id."""
    centroids = first_centroids(vectors, k, salt)
    k, dims = centroids.shape
    if not k:
        return Clustering(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids)
    none = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    state = written(none.mapInArrow(_assigner(centroids, np.ones(k, bool)), STATE))
    sums = None
    for _ in range(rounds):
        change = transfers(state, k, dims)
        every = change if sums is None else sums.unionByName(change)
        sums = written(every.groupBy("cluster", "at").agg(F.sum("delta").cast("decimal(38,0)").alias("delta")))
        total = np.zeros((k, dims + 1), object)
        for r in sums.collect():  # at most k * (dims + 1) rows
            total[r.cluster, r.at] = int(r.delta)
        means = [[s // row[dims] for s in row[:dims]] if row[dims] else list(old) for row, old in zip(total, centroids)]
        after = np.array(means, np.int64)
        moved = (after != centroids).any(axis=1)
        centroids = after
        if not moved.any():
            break
        state = written(state.select("vec_id", "v", "cluster", "distance").mapInArrow(_assigner(centroids, moved), STATE))
    return Clustering(state.select("vec_id", "cluster", "distance"), centroids)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster all sound vectors of ``embeddings``."""
    found = delta_lloyd(whole_vectors(table(spark, sf_dir, "embeddings")))
    shas = [(i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(found.centroids.tolist())]
    # One row a cluster: at most CLUSTERS.
    names = spark.createDataFrame(shas, "cluster int, centroid_sha256 string")
    by_cluster = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = by_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    extra = by_cluster.crossJoin(F.broadcast(whole)).join(F.broadcast(names), "cluster")
    return found.assigned.join(F.broadcast(extra), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _lloyd_sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    parts = [
        f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), v) - 1 AS c, v
    FROM v QUALIFY row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), v) <= {k}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f""", a{i} AS MATERIALIZED (
    SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT r, c, CAST(sum((e.x - f.x) * (e.x - f.x)) AS BIGINT) AS d
        FROM (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) e
        JOIN (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c{i}) f USING (i) GROUP BY r, c
    ) GROUP BY r
)"""
        )
        if i < rounds:
            parts.append(
                f""", m{i} AS (
    SELECT c, list(m ORDER BY i) AS v FROM (
        SELECT c, i, CAST((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT) AS m
        FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN v USING (r)) GROUP BY c, i
    ) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))"""
            )
    parts.append(
        f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} f ON f.c = a.c
"""
    )
    return "".join(parts)


OP12_SQL = _lloyd_sql()
