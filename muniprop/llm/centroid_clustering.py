"""Operator 12, centroid clustering in exact integers, nearest centroids by a bisector tournament.

Vectors become integers once and are staged. In each round the k centroids are plain numbers that
go out with the task; for every pair i < j the normal 2(c_j - c_i) and the threshold
|c_j|^2 - |c_i|^2 of the bisecting hyperplane are computed beforehand. A vector starts with
centroid 0 as champion and meets 1, 2, ..., k-1: the sign of normal . x - threshold says which of
the two is nearer, zero favours the smaller number, the loser is out. The distance is computed once,
to the last champion. Tasks return sums per centroid and component, which Spark adds up; only
k x (components + 1) numbers reach the driver, whatever the number of vectors. No vector is ever
grouped with others, so a vector that makes up a third of all rows is no hot key.

Defined results: vectors of another length, or with a null or non-finite component, are left out,
and so are those with an integer of 2^56 or more (their distances fit no column); a distance or sum
over 64 bits is null (the cluster is still exact); a null id hashes as ``null``; repeated ids and
repeated rows are separate vectors, at the start in order of their components; fewer than k vectors
give as many centroids; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muniprop.llm.common import stage, table

SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SEED = "3"
LARGEST = 1 << 56
LONG = 1 << 63
HALF = 31  # sums are kept in two parts of this many bits below
ROWS = 4096  # vectors compared at a time

Centroids = list[list[int]]


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS) -> DataFrame:
    """(vec_id, q): kept vectors as integers floor(SCALE * x)."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double") * SCALE)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where(F.size("x") == dims)
    good = F.forall("x", lambda v: F.coalesce(F.abs(v) < float(LARGEST), F.lit(False)))
    return rows.where(good).select("vec_id", F.transform("x", lambda v: F.floor(v)).alias("q"))


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> Centroids:
    """The k vectors with the smallest hashes of their ids, in that order: k rows to the driver."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(r["q"]) for r in kept.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()]


class Tournament:
    """Nearest centroids by the bisectors of all pairs."""

    def __init__(self, centroids: Centroids):
        c = np.array(centroids, dtype=object)
        self.exact = c
        self.largest = max(abs(v) for row in centroids for v in row)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        squares = (c * c).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]
        if self.fits(0):
            self.small = c.astype(np.int64), self.normals.astype(np.int64), self.thresholds.astype(np.int64)

    def fits(self, largest: int) -> bool:
        """Whether all steps for components up to ``largest`` stay within 64 bits."""
        n, c = self.exact.shape[1], self.largest
        return n * max(4 * c * largest + c * c, (c + largest) ** 2) < LONG // 2

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of ``x`` (64-bit integers)."""
        if self.fits(max(abs(int(x.min())), abs(int(x.max())))):
            c, normals, thresholds = self.small
        else:
            x, c, normals, thresholds = x.astype(object), self.exact, self.normals, self.thresholds
        champion = np.zeros(len(x), dtype=np.int64)
        for j in range(1, len(c)):
            side = (x * normals[champion, j]).sum(axis=1) - thresholds[champion, j]
            champion[(side > 0).astype(bool)] = j
        return champion, ((x - c[champion]) ** 2).sum(axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            piece = b.slice(at, ROWS)
            yield piece, piece.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def next_centroids(kept: DataFrame, centroids: Centroids) -> Centroids:
    """One round: every vector to its nearest centroid, centroids to the floored means of theirs."""
    contest, k, dims = Tournament(centroids), len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        count = np.zeros(k, np.int64)
        for _, x in _blocks(batches, dims):
            near, _ = contest.nearest(x)
            for c in np.unique(near).tolist():
                mine = x[near == c]
                high[c] += (mine >> HALF).sum(axis=0)
                low[c] += (mine & ((1 << HALF) - 1)).sum(axis=0)
                count[c] += len(mine)
        # Component -1 holds the number of vectors.
        cluster, dim = np.repeat(np.arange(k), dims + 1), np.tile(np.arange(-1, dims), k)
        both = [np.column_stack(part).ravel() for part in ((np.zeros(k, np.int64), high), (count, low))]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in (cluster, dim, *both)], ["cluster", "dim", "high", "low"])

    parts = kept.mapInArrow(sums, "cluster bigint, dim bigint, high bigint, low bigint")
    total = parts.groupBy("cluster", "dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    value = {(r["cluster"], r["dim"]): (int(r["high"]) << HALF) + int(r["low"]) for r in total.collect()}
    out = []
    for c, old in enumerate(centroids):
        n = value.get((c, -1), 0)
        out.append([value[c, d] // n for d in range(dims)] if n else old)
    return out


def assign(kept: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance, far): ``far`` has the distance if it is over 64 bits."""
    contest, dims = Tournament(centroids), len(centroids[0])
    kind = kept.schema["vec_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _blocks(batches, dims):
            near, distance = contest.nearest(x)
            beyond = distance >= LONG if distance.dtype == object else np.zeros(len(x), bool)
            far = [Decimal(int(d)) if b else None for d, b in zip(distance, beyond, strict=True)]
            fits = pa.array([None if b else int(d) for d, b in zip(distance, beyond, strict=True)], pa.int64())
            columns = [piece.column("vec_id"), pa.array(near.astype(np.int32)), fits, pa.array(far, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "far"])

    return kept.mapInArrow(rows, f"vec_id {kind}, cluster int, distance bigint, far decimal(38,0)")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding",
            dims: int = DIMS, seed: str = SEED) -> tuple[DataFrame, Centroids]:
    """Every kept vector with its cluster, and the final centroids."""
    kept = stage(integers(vectors, vec_id, embedding, dims), "cluster-vectors")
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        empty = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(None).cast("decimal(38,0)").alias("far"))
        return empty, centroids
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)
    return stage(assign(kept, centroids), "cluster-assigned"), centroids


def as_long(n: int) -> int | None:
    return n if n < LONG else None


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def described(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """Rows of ``cluster`` with the inertias and the digest of their centroid."""
    spark = rows.sparkSession
    each = F.coalesce(F.col("distance").cast("decimal(38,0)"), F.col("far"))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(each).alias("s")).collect()}  # k rows
    total = sum(sums.values())
    facts = [
        (c, as_long(sums.get(c, 0)), as_long(total), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
        for c, v in enumerate(centroids)
    ]
    per = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q "
        "FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS cid, q AS c FROM "
        "(SELECT sha256('3:' || coalesce(vec_id::VARCHAR, 'null')) AS h, q FROM v ORDER BY h, q LIMIT 8))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT rn, m.cid AS cid, m.d AS d FROM (SELECT rn, min({{'d': {distance}, 'cid': cid}}) AS m "
            f"FROM v, c{i} GROUP BY rn))"
        )
        if i < ROUNDS:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cid, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT cid, list(f ORDER BY dim) AS c FROM ("
                f"SELECT cid, dim, ((s - ((s % n) + n) % n) // n)::BIGINT AS f FROM (SELECT cid, dim, sum(q[dim]) AS s, count(*) AS n "
                f"FROM a{i} JOIN v USING (rn), range(1, 65) r(dim) GROUP BY cid, dim)) GROUP BY cid) m USING (cid))"
            )
    return (
        "WITH " + ",\n".join(parts)
        + f"\nSELECT vec_id, cid::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cid))::BIGINT AS cluster_inertia, "
        f"(sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN v USING (rn) JOIN c{ROUNDS} USING (cid)"
    )


OP12_SQL = _sql()
