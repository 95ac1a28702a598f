"""Operator 8, chat formatting over reply trees.

Nodes (node, parent, root's group, role, text, score) form reply trees. Root-to-leaf paths are
enumerated by iterative self-joins with doubling: after k rounds every node knows its ancestor
2^k steps up, the score gathered on the way and its depth, so a path of n turns takes about
log2(n) joins. Branches (leaves) are ranked by score within their tree; the nodes of the chosen
branches are marked by the same pointers, highest power first. Only narrow rows (ids, scores)
take part; texts join once, at the end.

Each chosen path is formatted as one conversation. Template, per turn:

  <turn ROLE>\\n TEXT </turn>\\n        (without the blanks)

Inside roles and texts a backslash is written ``\\\\`` and ``<`` is written ``\\l``, a role's
line break ``\\n``, its ``>`` ``\\g``: no text can contain a mark, and reading it back is exact.
The loss mask covers the texts of assistant turns, without marks.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text), nulls
first, so repeated and tied rows have a fixed order and all are kept; a null conv_id is a
conversation of its own; a parent that is absent makes its child a root; nodes on a cycle
belong to no root and are left out (``paths`` documents it); empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muniprop.llm.common import bounded, rounds_for, stage, table

ASSISTANT = "assistant"
EXTRA_CONVERSATION = "\\### Assistant: </turn> ok"  # the contract's conversation -7


# ---------------------------------------------------------------- reply trees


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, root, depth, total) of every node that reaches a root, and the pointer tables
    (node, up) by power of two. ``nodes``: node, parent, score.

    Round k joins only the nodes that still have an ancestor 2^k steps up; the others are done
    and are only looked up.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    up = F.when(F.col("there"), F.col("parent"))
    state = nodes.join(known, "parent", "left").select(
        "node", up.alias("up"), F.when(up.isNull(), F.col("node")).alias("root"), up.isNotNull().cast("bigint").alias("depth"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("total"),
    )
    done, jumps = None, []
    for k in range(rounds_for(max(2, nodes.count())) + 2):
        # state: ``up`` is the ancestor 2^k steps above (null past the root), ``depth`` the steps
        # to it, ``total`` the sum over the node and the ancestors below ``up``.
        state = stage(state, f"tree-{k}")
        ended = state.where("up is null")
        done = ended if done is None else done.unionByName(ended)
        state = state.where("up is not null")
        if state.limit(1).count() == 0:
            break
        jumps.append(state.select("node", "up"))
        above = done.unionByName(state).select(
            F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("d2"),
            F.col("total").alias("t2"),
        )
        state = state.join(above, "up").select(
            "node", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth"),
            (F.col("total") + F.col("t2")).alias("total"),
        )
    # What still points upwards after log2(n) rounds sits on a cycle.
    return done.select("node", "root", "depth", "total"), jumps


def choose_branches(nodes: DataFrame, reached: DataFrame, keep: int = 1) -> DataFrame:
    """(leaf, root, depth, total, rank) of the ``keep`` best branches of each tree: by total
    score, then length, then smallest leaf."""
    inner = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = reached.join(inner, "node", "left_anti")
    w = W.partitionBy("root").orderBy(F.col("total").desc(), F.col("depth").desc(), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return ranked.select(F.col("node").alias("leaf"), "root", "depth", "total", "rank")


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(leaf, root, rank, node, depth) for every node of the chosen branches. Nodes on a cycle,
    or below one, reach no root and are on no path."""
    reached, jumps = climb(nodes)
    chosen = stage(choose_branches(nodes, reached, keep), "tree-chosen")
    on = chosen.select("leaf", "root", "rank", F.col("leaf").alias("node"))
    for j in reversed(jumps):
        # With the highest jump first, every ancestor is met once: its distance in binary.
        on = stage(on.unionByName(on.join(j, "node").drop("node").withColumnRenamed("up", "node")), "tree-path")
    return on.join(reached.select("node", "depth"), "node")


# ---------------------------------------------------------------- template


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


UNESCAPED = {"\\\\": "\\", "\\l": "<", "\\g": ">", "\\n": "\n"}


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: UNESCAPED[m[0]], text) if "\\" in text else text


def segment(role: Column, text: Column) -> Column:
    """One formatted turn."""
    return F.concat(F.lit("<turn "), escape_role(role), F.lit(">\n"), escape(text), F.lit("</turn>\n"))


def read_segment(formatted: str) -> tuple[str, str, int, int]:
    """(role, text, mask start, mask end) of one formatted turn; the mask is in code points of
    the segment."""
    head = formatted.index(">\n")
    start, end = head + 2, len(formatted) - len("</turn>\n")
    return unescape(formatted[len("<turn ") : head]), unescape(formatted[start:end]), start, end


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows of linear conversations as a reply tree: each turn answers the one before it.
    node and parent are (conversation, place); the score is the text's length."""
    place = F.row_number().over(
        W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    c = c.withColumn("place", place.cast("bigint"))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return c.select(
        F.concat(name, F.lit(":"), F.col("place").cast("string")).alias("node"),
        F.when(F.col("place") > 1, F.concat(name, F.lit(":"), (F.col("place") - 1).cast("string"))).alias("parent"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("score"), "conv_id", "role", "text",
    )


def format_conversations(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, rank, depth, segment, loss) of the chosen path of every tree, one row a turn:
    a conversation's formatted text is its segments in order of depth (``assemble``). ``loss``
    says that the segment's text is under the loss mask."""
    slim = stage(nodes.select("node", "parent", "score"), "tree-nodes")
    on = paths(slim, keep).select("node", "rank", "depth")
    return nodes.select("node", "conv_id", "role", "text").join(on, "node").select(
        "conv_id", "rank", "depth", segment(F.col("role"), F.col("text")).alias("segment"),
        (F.coalesce("role", F.lit("")) == ASSISTANT).alias("loss"),
    )


def assemble(formatted: DataFrame) -> DataFrame:
    """(conv_id, rank, text): each chosen path as one conversation."""
    g = formatted.groupBy("conv_id", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "segment"))).alias("s"))
    return g.select("conv_id", "rank", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"))


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted turns. A conversation streams
    through one task turn by turn (a digest is sequential); nothing of it is kept."""
    dealt = formatted.where("rank = 1").repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, chars, loss_chars = None, 0, 0, 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def row() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            values = (now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for b in bounded(batches, 1):
            for conv, seg, masked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n and conv != now:
                    yield row()
                    n, chars, loss_chars = 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, text, start, end = read_segment(seg)
                turns.update(f"{role}\n{text}\n".encode())
                if masked:
                    inside = unescape(seg[start:end])
                    loss.update(inside.encode())
                    loss_chars += len(inside)
                now, n, chars = conv, n + 1, chars + len(seg)
        if n:
            yield row()

    return dealt.select("conv_id", "segment", "loss").mapInArrow(run, DIGESTS)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    )
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(ASSISTANT)).alias("role"), F.lit(EXTRA_CONVERSATION).alias("text"),
    )
    return read_back(format_conversations(conversation_nodes(given.unionByName(extra))))
