"""Operator 7, SimHash near-duplicates by vantage-point trees.

Fingerprints (64 bits) are computed per document in Arrow batches, then collapsed to distinct
values, so a group of exact copies of any size is one point. A vantage-point tree built from a
bounded sample partitions the points by Hamming distance: each inner node splits at a distance
from its vantage point, and the triangle bound |d(a,v) - d(b,v)| <= d(a,b) tells which side a
neighbour within ``max_bits`` can be on. Every point is stored in its own shard (leaf) and sent
as a query to the other shards its ball overlaps (only those with a larger number: the pair is
found once). Inside a shard the same tree is built over its points and pruned the same way, so
pairs are compared exactly only in overlapping leaves. A shard that the tree cannot split (a dense
ball, seen in the sample) is cut into blocks, each pair of blocks a group of its own. A shard reports a spanning forest of its
links, never all pairs; components are joined over those links in Spark.

Sampled: only the vantage points (``TREE_SAMPLE`` fingerprints on the driver, 8 bytes each).
Their choice changes the balance of the shards, never the result: every fingerprint is indexed.

Defined results: null and empty texts have no words and fingerprint zero, linked like any
other; null ids are kept and are last when a component picks its smallest id; repeated rows
share a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muniprop.llm.common import connected_components, fresh, stage, table

SHINGLE, MAX_BITS, SEED = 3, 3, 42
TREE_SAMPLE = 200_000  # upper bound of fingerprints gathered for the tree's upper part
SHARD_POINTS = 16_000  # intended points of a shard: 9 bytes each; fewer shards mean fewer visiting queries
LEAF = 256  # points compared exhaustively in a shard's own tree


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


# A tree is nested tuples (vantage, radius, inner, outer) or a leaf number.
Tree = int | tuple


def split_of(points: np.ndarray, seed: int, bits: int) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that send the fewest points to both sides; None if the points
    cannot be separated by more than their own ball."""
    rng = np.random.default_rng(seed)
    probe = points if len(points) <= 512 else points[rng.integers(0, len(points), 512)]
    best, size, r = None, len(probe), np.arange(64)
    for v in points[rng.integers(0, len(points), 8)]:
        inner = np.concatenate(([0], np.cumsum(np.bincount(np.bitwise_count(probe ^ v), minlength=65))))
        within = inner[r + 1]  # points at distance <= r
        both = inner[np.minimum(64, r + bits) + 1] - inner[np.maximum(0, r - bits + 1)]
        usable = (np.minimum(within, size - within) >= max(1, size // 8)) & (both < 0.98 * size)
        cost = np.where(usable, both + 0.5 * np.abs(2 * within - size), np.inf)
        radius = int(np.argmin(cost))
        if np.isfinite(cost[radius]) and (best is None or cost[radius] < best[0]):
            best = (cost[radius], v, radius)
    return best and (best[1], best[2])


def build_tree(points: np.ndarray, leaf: int, bits: int) -> tuple[Tree, list[int]]:
    """Tree over a sample and the sample points of each leaf; leaves are numbered from left to right."""
    sizes: list[int] = []

    def grow(p: np.ndarray, depth: int) -> Tree:
        cut = split_of(p, len(p) + depth, bits) if len(p) > leaf and depth < 40 else None
        if cut is None:
            sizes.append(len(p))
            return len(sizes) - 1
        inside = np.bitwise_count(p ^ cut[0]) <= cut[1]
        return (cut[0], cut[1], grow(p[inside], depth + 1), grow(p[~inside], depth + 1))

    return grow(np.unique(points), 0), sizes


def walk(tree: Tree, fps: np.ndarray, at: np.ndarray, reach: int, out: list[tuple[int, np.ndarray]]) -> None:
    """Append (leaf, positions in fps) for every leaf within ``reach`` of a fingerprint."""
    if not len(at):
        return
    if not isinstance(tree, tuple):
        out.append((tree, at))
        return
    v, radius, inner, outer = tree
    d = np.bitwise_count(fps[at] ^ v).astype(np.int64)
    walk(inner, fps, at[d - reach <= radius], reach, out)
    walk(outer, fps, at[d + reach > radius], reach, out)


def links_within(points: np.ndarray, queries: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (point, query) of all pairs within ``bits``, block by block, found through a
    tree over the shard's points. A point is also its own query if it is passed as one."""

    def join(p: np.ndarray, q: np.ndarray, depth: int):
        if not len(p) or not len(q):
            return
        cut = split_of(points[p], len(p) + depth, bits) if len(p) > LEAF and depth < 60 else None
        if cut is None:
            step = max(1, 1_000_000 // len(p))
            for i in range(0, len(q), step):
                part = q[i : i + step]
                a, b = np.nonzero(np.bitwise_count(points[p][:, None] ^ queries[part][None, :]) <= bits)
                if len(a):
                    yield p[a], part[b]
            return
        v, radius = cut
        dp = np.bitwise_count(points[p] ^ v)
        dq = np.bitwise_count(queries[q] ^ v).astype(np.int64)
        yield from join(p[dp <= radius], q[dq - bits <= radius], depth + 1)
        yield from join(p[dp > radius], q[dq + bits > radius], depth + 1)

    yield from join(np.arange(len(points)), np.arange(len(queries)), 0)


def spanning_forest(n: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes through the linked pairs."""
    parent = np.arange(n)

    def flatten() -> None:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return
            parent[:] = up

    for a, b in blocks:
        while True:
            flatten()
            ra, rb = parent[a], parent[b]
            open_ = ra != rb
            if not open_.any():
                break
            np.minimum.at(parent, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
    flatten()
    return parent


def shard_links(fps: np.ndarray, home: np.ndarray, bits: int, among: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) among a shard's home points and the visiting queries. ``home`` marks
    the points; visitors are compared with points only, the points with one another if ``among``."""
    points = fps[home]
    order = np.concatenate([np.nonzero(home)[0], np.nonzero(~home)[0]])
    skip = 0 if among else len(points)
    found = ((a, b + skip) for a, b in links_within(points, fps[order[skip:]], bits))
    root = spanning_forest(len(fps), found)
    far = np.nonzero(root != np.arange(len(fps)))[0]
    return fps[order[far]], fps[order[root[far]]]


def cells(blocks: int, fp: np.ndarray, own: bool) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """(point block, query block, positions, home) of a shard's fingerprints. The fingerprints of a
    shard that no vantage point splits are dealt to ``blocks`` by a hash, as points and as queries, and
    each pair of blocks is a group of its own. Points are wanted wherever queries of a block meet
    them; as queries, they meet the smaller blocks only, so a pair is compared once."""
    if blocks == 1:
        yield 0, 0, np.arange(len(fp)), own
        return
    block = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(blocks)
    for b in range(blocks):
        at = np.nonzero(block == b)[0]
        if len(at):
            if own:
                yield from ((b, q, at, True) for q in range(blocks))
            yield from ((p, b, at, False) for p in range(b if own else blocks))


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints ``fps`` (column fp) that are
    connected by steps of at most ``bits`` differing bits."""
    n = fps.count()
    take = min(TREE_SAMPLE, n, max(2_000, 16 * (n // SHARD_POINTS)))
    # A hash-random sample (the lowest hashes), so a rerun builds the same tree.
    sample = [r["fp"] for r in fps.orderBy(F.xxhash64("fp", F.lit(7))).limit(take).collect()]
    leaf = max(8, len(sample) * SHARD_POINTS // max(1, n))
    tree, sizes = build_tree(np.array(sample, np.int64).view(np.uint64), leaf, bits)
    # Leaves that stayed far above the intended size are dense balls: cut into blocks.
    blocks = [max(1, -(-size * n // (2 * SHARD_POINTS * max(1, len(sample))))) for size in sizes]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            every = np.arange(len(fp))
            own = np.zeros(len(fp), np.int64)
            near: list[tuple[int, np.ndarray]] = []
            home: list[tuple[int, np.ndarray]] = []
            walk(tree, fp, every, 0, home)
            for shard, at in home:
                own[at] = shard
            walk(tree, fp, every, bits, near)
            for shard, at in near:
                for mine in (True, False):
                    some = at[own[at] == shard] if mine else at[own[at] < shard]
                    for p, q, which, is_home in cells(blocks[shard], fp[some], mine):
                        if len(which):
                            size = len(which)
                            yield pa.RecordBatch.from_arrays(
                                [*(pa.array(np.full(size, x, np.int32)) for x in (shard, p, q)), pa.array(fp[some[which]].view(np.int64)),
                                 pa.array(np.full(size, is_home))],
                                names=["shard", "p", "q", "fp", "home"],
                            )

    def search(key: tuple, batch: pa.Table) -> pa.Table:
        fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        among = key[1].as_py() == key[2].as_py()
        a, b = shard_links(fp, batch.column("home").to_numpy().astype(bool), bits, among)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    routed = fps.select("fp").mapInArrow(route, "shard int, p int, q int, fp bigint, home boolean")
    return routed.groupBy("shard", "p", "q").applyInArrow(search, "a bigint, b bigint")


def rows_and_components(docs: DataFrame, doc_id: str, text: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, fp) of every row and (fp, root, component_id) of every fingerprint. The
    root (a fingerprint) names a component; its component_id is null if all its ids are, and two
    components share it if one id is the smallest of both."""
    rows = stage(with_fingerprints(docs, doc_id, text), "simhash-fp")
    points = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-points")
    roots = connected_components(fingerprint_links(points.select("fp"), bits))
    tagged = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    small = tagged.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows, stage(tagged.join(small, "root").select("fp", "root", "component_id"), "simhash-components")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    rows, by_fp = rows_and_components(docs, doc_id, text, bits)
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the one with the smallest id, null ids last (of several rows
    with that id, the one with the smallest text; of wholly equal ones any)."""
    key, n, fp, component, root, rn = fresh(docs.columns, "sh_key", "sh_n", "sh_fp", "sh_component", "sh_root", "sh_rn")
    rows, by_fp = rows_and_components(docs.select(doc_id, text), doc_id, text, bits)
    # Ids that are the smallest of a component, with all rows that carry them in any component.
    smallest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = rows.join(by_fp, "fp").groupBy(F.col("doc_id").alias(key))
    first = first.agg(F.count(F.lit(1)).alias(n), F.max(smallest).alias(component)).where(F.col(component)).drop(component)
    j = docs.join(first, F.col(doc_id).cast("bigint").eqNullSafe(F.col(key)))
    once = j.where(F.col(n) == 1)
    # An id on several rows: those rows alone are fingerprinted again to tell their components.
    print_of = F.pandas_udf(lambda texts: texts.map(fingerprint), "bigint")
    again = j.where(F.col(n) > 1).withColumn(fp, print_of(F.col(text).cast("string")))
    named = by_fp.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(component))
    again = again.join(named, fp).where(F.col(component).eqNullSafe(F.col(key)))
    again = again.withColumn(rn, F.row_number().over(W.partitionBy(root).orderBy(text))).where(F.col(rn) == 1)
    every = once.unionByName(again.drop(fp, component, root, rn))
    return every.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = components(docs)
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
