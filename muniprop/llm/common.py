"""Helpers shared by the training-data operators: reading, staging, words, components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muniprop.session import materialize, scratch_path

# FIXED VALUES: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back (lineage cut)."""
    return materialize(df, f"llm-{name}")


def stage_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def bounded(batches: Iterator[pa.RecordBatch], column: int, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece have at most ``limit`` bytes together
    (a longer text is a piece of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        total, start = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > limit:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        yield b.slice(start)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that do not clash with ``taken`` (case-insensitive)."""
    low = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def exploded_min(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours; partial aggregation per task."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge table (a, b); root = smallest node.

    Alternating large-star / small-star steps. Each step is one aggregation of the minimum
    neighbour per node and one equi-join back; nodes and links never leave the cluster, a hot
    node is split by the skew join, and every round is cut by a staged table. The loop ends
    when a full round leaves the edge multiset unchanged (count and order-free hash sum).
    Raises if ``max_rounds`` (far above the logarithmic number needed) do not suffice.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stage(e, "cc0")
    mark = None
    for i in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == mark:
            break
        mark = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u links to the smallest node around u.
        large = (
            both.join(exploded_min(both), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = stage(large, f"cc{i}l")
        # Small star: u (larger end) and its smaller neighbours link to their minimum.
        low = exploded_min(large)
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        e = stage(small, f"cc{i}s")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


def rounds_for(longest: int) -> int:
    """Doubling rounds that reach a distance of ``longest``."""
    return max(1, math.ceil(math.log2(max(2, longest))))


Query = Callable[[SparkSession, str], DataFrame]
