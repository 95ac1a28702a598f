"""Operator 13, resampling documents towards a target by hashed n-gram importance weights.

A document's words are joined by one space and scanned once, byte by byte, keeping the running
CRC-32 before and after every word. CRCs are linear over GF(2): the CRC of a stretch B that follows
a prefix A is crc(AB) xor the CRC of A moved on by len(B) zero bytes, so the CRC of every n-gram
comes from two stored prefixes and no n-gram is ever built or hashed. Moving on is a fixed linear
map per length: a table for lengths below 256, squared maps for the bits above.

The corpus is read twice: once for the number of features in each bucket (a histogram per task, added up
by Spark), once for the documents' weights. The gains are one number per bucket, a bound that does
not depend on the data. Ranks come from a range-partitioned sort of narrow rows and a prefix sum of
partition sizes; the row's number breaks ties of score and id, so repeated rows are spread too.

Defined results: a null or empty text has no words, no features and weight 0; a null id hashes as
``null`` and comes after all others in a tie; repeated rows are separate rows that get different
ranks; an empty corpus gives an empty result, an empty target has T = 0; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muniprop.llm.common import bounded, fresh, stage, table
from muniprop.sources.properties import with_dense_id

BUCKETS = 10_000
LONGEST = 2  # words of the longest n-gram
SEED = "7"
PERCENT = 25
LEAST_WORDS = 20
PIECE = 4 << 20  # bytes of text worked on at a time (a longer text is a piece of its own)
TABLE = 256  # lengths with a map of their own

# Lower-case letters, digits and all bytes of other characters are kept, A-Z are lowered, the rest separates.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    """CRC registers after one more zero byte."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


def _moved(maps: np.ndarray, crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """``crc`` through map number ``n`` of ``maps`` (lengths, 4 bytes of the register, 256 values)."""
    out = maps[n, 0, crc & np.uint32(255)]
    for byte in (1, 2, 3):
        out = out ^ maps[n, byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def _maps() -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    small = [step]
    for _ in range(TABLE):
        small.append(_zero_byte(small[-1]))
    large = [small.pop()]  # TABLE zero bytes, then twice as many each time
    for _ in range(31):
        large.append(_moved(large[-1][None], large[-1], 0))
    return np.stack(small), np.stack(large)


SMALL, LARGE = _maps()


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved on by ``n`` zero bytes each."""
    out = _moved(SMALL, crc, n % TABLE)
    high, bit = n // TABLE, 0
    while high.any():
        odd = (high & 1).astype(bool)
        out[odd] = _moved(LARGE, out[odd], bit)
        high, bit = high >> 1, bit + 1
    return out


def scan(text: bytes | None) -> tuple[list[int], list[int], list[int]]:
    """Running CRCs before and after each word of the space-joined words, and the words' lengths."""
    words = (text or b"").translate(_KEEP).split()
    before, after, crc, add = [], [], 0, zlib.crc32
    for w in words:
        before.append(crc)
        crc = add(w, crc)
        after.append(crc)
        crc = add(b" ", crc)
    return before, after, [len(w) for w in words]


def features(texts: list[bytes | None], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, text of each feature, bucket of each feature)."""
    before, after, length, words = [], [], [], []
    for t in texts:
        b, a, n = scan(t)
        before += b
        after += a
        length += n
        words.append(len(n))
    words = np.array(words, np.int64)
    before, after, length = np.array(before, np.uint32), np.array(after, np.uint32), np.array(length, np.int64)
    of = np.repeat(np.arange(len(texts)), words)
    end = np.cumsum(length + 1)  # also across texts; only differences within one are used
    found_of, found = [of], [after ^ shift(before, length)]
    for n in range(2, longest + 1):
        last = np.arange(n - 1, len(of))
        last = last[of[n - 1 :] == of[: len(of) - n + 1]] if len(of) >= n else last[:0]
        first = last - n + 1
        size = end[last] - end[first] + length[first]
        found_of.append(of[last])
        found.append(after[last] ^ shift(before[first], size))
    return words, np.concatenate(found_of), np.concatenate(found).astype(np.int64) % buckets


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for b in batches:
        for piece in bounded(iter([b]), b.schema.get_field_index(column), PIECE):
            yield piece, piece.column(column).cast(pa.large_binary()).to_pylist()


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches, "text"):
            total += np.bincount(features(texts, buckets, longest)[2], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS,
          longest: int = LONGEST) -> list[int]:
    """The gain of every bucket: ``buckets`` numbers, the only thing that reaches the driver."""
    s = bucket_counts(docs, text, buckets, longest).withColumnRenamed("n", "s")
    t = bucket_counts(target, target_text, buckets, longest).withColumnRenamed("n", "t")
    got = stage(s.join(t, "bucket", "full").na.fill(0, ["s", "t"]), "resample-buckets")
    every = got.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s1, t1 = F.col("s").cast("double") + 1, F.col("t").cast("double") + 1
    ratio = (t1 * float(every[0] + buckets)) / (s1 * float(every[1] + buckets))
    rows = got.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(got, "bucket", "left").na.fill(0, ["s", "t"])
    return [r["gain"] for r in rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def weighed(docs: DataFrame, gain: list[int], text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str, str] = ("n_words", "n_features", "weight"), longest: int = LONGEST) -> DataFrame:
    """The columns ``keep`` of every document with its number of words and features and its weight."""
    value = np.array(gain, np.int64)
    body = fresh(list(keep), "resample_text")[0]
    # The text goes last, so that a column of ``keep`` may be the text itself.
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(body))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _texts(batches, body):
            words, of, bucket = features(texts, len(value), longest)
            n = np.bincount(of, minlength=len(texts)).astype(np.int64)
            total = np.bincount(of, weights=value[bucket], minlength=len(texts)).astype(np.int64)  # below 2^53: exact
            weight = total // np.maximum(n, 1)
            columns = [piece.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words), pa.array(n), pa.array(weight)], [*keep, *names])

    schema = T.StructType([f for f in source.schema.fields if f.name != body] + [T.StructField(n, T.LongType()) for n in names])
    return source.mapInArrow(weigh, schema)


def score(weight: Column, doc_id: Column, seed: str = SEED) -> Column:
    """weight + a Gumbel variate from the id's hash, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10)
    return weight + F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
               least_words: int = LEAST_WORDS, seed: str = SEED, longest: int = LONGEST) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and, if drawn, rank."""
    rows = weighed(docs, gain, text, (doc_id,), longest=longest).withColumnRenamed(doc_id, "doc_id")
    rows = rows.withColumns({"score": score(F.col("weight"), F.col("doc_id"), seed), "rid": F.monotonically_increasing_id()})
    rows = stage(rows, "resample-scores")
    able = F.col("n_words") >= least_words
    take = rows.where(able).count() * percent // 100
    order = rows.where(able).withColumns({"down": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("int")})
    ranked = with_dense_id(order, ("down", "no_id", "doc_id", "rid"), start=1)
    ranked = ranked.withColumn("rank", F.when(F.col("id") <= take, F.col("id")))
    every = ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint")), allowMissingColumns=True)
    return every.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs`` themselves, with all their columns.

    The draw is a cut in (score, id) order: the second pass over the texts needs the last drawn
    place only, and the number of rows to take of those that share it (repeated ids).
    """
    gain = gains(docs, target, text, target_text)
    places = stage(importance(docs, gain, doc_id, text, **options), "resample-ranks")
    last = places.where("rank is not null").orderBy(F.col("rank").desc()).limit(1).collect()
    if not last:
        return docs.where(F.lit(False))
    cut = last[0]
    tied = (F.col("score") == cut["score"]) & F.col("doc_id").eqNullSafe(F.lit(cut["doc_id"]))
    n_tied = places.where(tied & F.col("rank").isNotNull()).count()
    words, n, weight, s, place = fresh(docs.columns, "rs_words", "rs_features", "rs_weight", "rs_score", "rs_place")
    rows = weighed(docs, gain, text, tuple(docs.columns), (words, n, weight))
    rows = rows.withColumn(s, score(F.col(weight), F.col(doc_id), options.get("seed", SEED)))
    rows = rows.where(F.col(words) >= options.get("least_words", LEAST_WORDS))
    here = F.col(doc_id)
    same = (F.col(s) == cut["score"]) & here.eqNullSafe(F.lit(cut["doc_id"]))
    smaller = here.isNotNull() if cut["doc_id"] is None else F.coalesce(here < cut["doc_id"], F.lit(False))
    ahead = (F.col(s) > cut["score"]) | (F.col(s) == cut["score"]) & smaller
    ties = rows.where(same).withColumn(place, F.row_number().over(W.partitionBy(s).orderBy(n))).where(F.col(place) <= n_tied)
    return rows.where(ahead & ~same).unionByName(ties.drop(place)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = gains(docs, table(spark, sf_dir, "benchmark").select("text"))
    return importance(docs, gain).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


OP13_SQL = r"""
WITH tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT 0 AS part, row_number() OVER () AS rn, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS MATERIALIZED (
  SELECT part, rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), f AS MATERIALIZED (
  SELECT part, rn, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM w WHERE len(ws) > 0
), u AS (
  SELECT DISTINCT g FROM f
), b AS MATERIALIZED (
  SELECT g, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(g))), lambda k: ('0x' || substr(hex(encode(g)), 2 * k + 1, 2))::BIGINT),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tab
), n AS (
  SELECT bucket, count(*) FILTER (WHERE part = 0) AS s, count(*) FILTER (WHERE part = 1) AS t FROM f JOIN b USING (g) GROUP BY bucket
), gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM n
), per AS (
  SELECT rn, ((sum(gain.g) - ((sum(gain.g) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE part = 0 GROUP BY rn
), d AS (
  SELECT doc_id, len(ws) AS n_words, CASE WHEN len(ws) = 0 THEN 0 ELSE 2 * len(ws) - 1 END AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM w LEFT JOIN per USING (rn) WHERE part = 0
), sc AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (WHERE n_words >= 20) OVER () AS able FROM sc
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND k <= able * 25 // 100 THEN k END AS rank, n_words::BIGINT AS n_words FROM r
"""
