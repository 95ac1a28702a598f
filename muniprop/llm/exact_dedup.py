"""Operator 11, exact duplicates by skew-safe combining of whole texts.

Texts are equal when identical after each run of white space is one space. Rows are combined in
three stages, each of which groups by the digest and by the whole text, so no digest decides alone:

* locally: the partial aggregation of a task leaves one row per distinct text;
* by salt: hot digests (with over 1/``HOT_SHARE`` of all rows, so at most ``HOT_SHARE`` of them:
  the bound of their broadcast) are spread over ``SALTS`` groups by the task they come from, all
  other digests are complete after this stage;
* globally: the winners of the salts of a hot digest are combined. Texts of other digests go no
  further; what is left of them is a count, which shows if a digest held two different texts.

Every text is shuffled once. The class is then attached to the narrow rows (id and digest) by an
equi-join on the digest, for hot digests by a broadcast. Digests that held different texts (found
by the comparison, none for SHA-256 so far) are combined again with the text as the key.

Defined results: a null text counts as empty; a null id is larger than any other, so it stays only
where the whole class has null ids; of several rows with the id that stays, one is kept (the first
in reading order); an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muniprop.llm.common import SPACES, fresh, stage, table

SALTS = 32
HOT_SHARE = 10_000


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def combine(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(digest, hot, keep_id, group_size, texts): one row per class of ``rows`` (doc_id, content,
    digest). For a digest that is not hot there is one row and ``texts`` counts its texts."""
    marks = F.broadcast(hot.select("digest", F.lit(True).alias("hot")))
    salted = rows.join(marks, "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    )
    winners = salted.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # Only hot digests have a salt and carry their text on.
    left = winners.select("digest", F.when(F.col("salt").isNotNull(), F.col("content")).alias("content"), "keep_id", "n")
    per = left.groupBy("digest", "content").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("parts")
    )
    is_hot = F.col("content").isNotNull()
    return per.select("digest", is_hot.alias("hot"), "keep_id", "group_size", F.when(is_hot, F.lit(1)).otherwise(F.col("parts")).alias("texts"))


def attach(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the ``facts`` of their digest; facts of hot digests (``hot``, at most
    ``HOT_SHARE`` rows) are broadcast, so no task gets all rows of a hot digest."""
    few = facts.where("hot").drop("hot")
    rest = facts.where("not hot").drop("hot")
    spread = rows.join(F.broadcast(few), "digest")
    others = rows.join(F.broadcast(few.select("digest")), "digest", "left_anti").join(rest, "digest", how)
    return spread.unionByName(others)


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of ``rows`` (doc_id, content, sha, digest), and the digests left out of them
    because they hold different texts."""
    members = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "sha", "digest")
    members = stage(members, "dedup-rows")
    limit = members.count() // HOT_SHARE
    hot = stage(members.groupBy("digest").count().where((F.col("count") > limit) & (F.col("count") > 1)), "dedup-hot")
    found = stage(combine(rows.select("doc_id", "content", "digest"), hot), "dedup-classes")
    clash = stage(found.groupBy("digest").agg(F.sum("texts").alias("n")).where("n > 1").select("digest"), "dedup-clash")
    if not clash.isEmpty():
        found = found.join(clash, "digest", "left_anti")
        members = members.join(clash, "digest", "left_anti")
    out = attach(members, found.drop("texts"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Ids that occur several times in one class: only the first of their rows may stay.
    again = members.groupBy("digest", "doc_id").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    again = again.join(found.select("digest", "keep_id"), "digest").where(stays)
    again = stage(again.select("digest", "first", (F.col("c") > limit).alias("hot")), "dedup-again")
    if not again.isEmpty():
        out = attach(out, again, "left")
        stays = stays & F.coalesce(F.col("rid") == F.col("first"), F.lit(True))
    return out.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "sha"), clash


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, sha (of the normalised text).
    ``digest_bytes`` of the SHA-256 find candidates; fewer only mean more texts compared twice."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("content"))
    rows = rows.withColumn("sha", sha(F.col("content")))
    rows = rows.withColumn("digest", F.substring("sha", 1, digest_bytes))
    out, clash = _classes(rows)
    if not clash.isEmpty():
        odd = rows.join(clash, "digest", "left_semi").withColumn("digest", F.encode("content", "UTF-8"))
        out = out.unionByName(_classes(odd)[0])
    return out


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    s, i, n = fresh(docs.columns, "dedup_sha", "dedup_id", "dedup_n")
    best = classes(docs, doc_id, text).where("kept").select(F.col("sha").alias(s), F.col("doc_id").alias(i))
    mine = docs.withColumn(s, sha(normalised(F.col(text))))
    best = best.withColumnRenamed(s, s + "_best")
    same = (mine[s] == best[s + "_best"]) & mine[doc_id].eqNullSafe(best[i])
    # Rows of one id and text that differ elsewhere: one of them, cut before the shuffle.
    first = F.row_number().over(W.partitionBy(s, doc_id).orderBy(s))
    return mine.join(best, same, "left_semi").withColumn(n, first).where(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY content) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
  row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(content) AS text_sha256
FROM d
"""
