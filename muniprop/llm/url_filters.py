"""Operator 1, URL filters as a sort-merge range join.

A host is written as its reversed labels, each closed by a dot (``blog.example.net`` becomes
``net.example.blog.``). A rule's host and all its subdomains then are one interval of keys
(those that start with the rule's key), and intervals of rules are nested or apart. Urls and
rules are range-partitioned and sorted together by that key; each partition is swept once with
a stack of the active (nested) rules. Rules that opened in an earlier partition enter as seeds:
they are exactly the rules at a prefix of the partition's first key, found by an equi-join of
those prefixes. A url asks the frames on the stack for rules whose path its own path starts
with; the longest rule wins.

Urls of one host differ in path and id and are part of the sort key, so a hot host is cut
over many partitions. A task holds one Arrow batch and the rules of one chain of hosts.

Defined results: a null url or one without ``://`` has empty host and path and gets the default
verdict; repeated rows and null ids are judged row by row; of two rules with equal host and
path the first in order of (verdict, string) wins; a rule without host fits every
host; no rules: the default verdict everywhere;
an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muniprop.llm.common import partitions, stage, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"
# The contract's rules: (rule string, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + F.lit(3), F.char_length(u))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a dot; an empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    )


def rules_frame(spark: SparkSession, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rule strings (host, then path from the first slash) as a table (rule, verdict)."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def split_rules(rules: DataFrame) -> DataFrame:
    """(rkey, rpath, rule, rverdict) of rules (rule, verdict); hosts are lower-cased."""
    r = F.col("rule")
    host = F.translate(F.regexp_extract(r, r"^([^/]*)", 1), UPPER, LOWER)
    keyed = rules.where(r.isNotNull()).select(
        host_key(host).alias("rkey"), F.regexp_extract(r, r"^[^/]*(.*)$", 1).alias("rpath"), "rule",
        F.col("verdict").alias("rverdict"),
    )
    return keyed.groupBy("rkey", "rpath").agg(F.min(F.struct("rverdict", "rule")).alias("m")).select(
        "rkey", "rpath", "m.rule", "m.rverdict"
    )


class Frame(NamedTuple):
    """The rules of one host on the stack."""

    key: str
    by_path: dict[str, tuple[str, str]]  # path -> (rule, verdict)
    sizes: list[int]  # distinct lengths of the paths, longest first


class Sweep:
    """Stack of active rules while keys come in ascending order."""

    def __init__(self) -> None:
        self.stack: list[Frame] = []

    def enter(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(Frame(key, {}, []))
        top = self.stack[-1]
        top.by_path[path] = (rule, verdict)
        if len(path) not in top.sizes:
            top.sizes.append(len(path))
            top.sizes.sort(reverse=True)

    def close(self, key: str) -> None:
        """Leave the rules whose interval ends before ``key``."""
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def ask(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest active rule that fits; of equally long ones that of the longer host."""
        self.close(key)
        best: tuple[str, str] | None = None
        for frame in reversed(self.stack):
            for n in frame.sizes:
                if n <= len(path) and (hit := frame.by_path.get(path[:n])) and (best is None or len(hit[0]) > len(best[0])):
                    best = hit
        return best


SWEPT = "page_id bigint, host string, path string, rule string, verdict string"


def judge(urls: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``urls``."""
    n = partitions(urls.sparkSession)
    pages = urls.select(F.col(page_id).cast("bigint").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    pages = pages.withColumn("key", host_key(F.col("host")))
    split = stage(split_rules(rules), "url-rules")
    # kind: 0 seed of a partition, 1 rule, 2 url; a rule stands before the urls it covers.
    no = F.lit(None)
    rule_rows = split.select(no.cast("bigint").alias("page_id"), no.cast("string").alias("host"), F.col("rpath").alias("path"),
                             F.col("rkey").alias("key"), F.lit(1).alias("kind"), "rule", F.col("rverdict").alias("verdict"))
    url_rows = pages.select("page_id", "host", "path", "key", F.lit(2).alias("kind"), no.cast("string").alias("rule"), no.cast("string").alias("verdict"))
    ranged = url_rows.unionByName(rule_rows).repartitionByRange(n, "key", "kind", "path", "page_id")
    ranged = stage(ranged.withColumn("part", F.spark_partition_id()), "url-ranged")
    # Seeds: rules at a proper prefix of the first key of a partition that start before it.
    heads = ranged.groupBy("part").agg(F.min(F.struct("key", "kind", "path")).alias("first"))
    labels = F.split(F.col("first.key"), r"\.", -1)
    prefix = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.concat(
        F.array_join(F.slice(labels, 1, i), "."), F.when(i > 0, F.lit(".")).otherwise(F.lit(""))))
    asked = heads.select("part", "first", F.explode(F.array_distinct(F.concat(prefix, F.array(F.col("first.key"))))).alias("rkey"))
    before = F.struct(F.col("rkey").alias("key"), F.lit(1).alias("kind"), F.col("rpath").alias("path")) < F.col("first")
    seeds = asked.join(split, "rkey").where(before).select(
        no.cast("bigint").alias("page_id"), no.cast("string").alias("host"), F.col("rpath").alias("path"),
        F.col("rkey").alias("key"), F.lit(0).alias("kind"), "rule", F.col("rverdict").alias("verdict"), "part",
    )
    every = ranged.unionByName(seeds).repartitionByRange(n, "part")
    order = ("part", F.when(F.col("kind") == 0, 0).otherwise(1), "key", "kind", "path", "page_id")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, Sweep()
        for b in batches:
            c = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            out: list[tuple] = []
            for p, kind, key, path, host, page, rule, verdict in zip(
                c["part"], c["kind"], c["key"], c["path"], c["host"], c["page_id"], c["rule"], c["verdict"], strict=True
            ):
                if p != part:
                    part, state = p, Sweep()
                if kind < 2:
                    state.enter(key, path, rule, verdict)
                else:
                    out.append((page, host, path, *(state.ask(key, path) or (None, default))))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)],
                                             names=["page_id", "host", "path", "rule", "verdict"])

    return every.sortWithinPartitions(*order).mapInArrow(sweep, SWEPT)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, RULES))


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), m AS (
  SELECT p.*, r.rule, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
