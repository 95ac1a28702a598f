"""Operator 3, removal of repeated byte strings by blockwise suffix sorting.

A byte is removed if a string of ``WINDOW`` bytes that covers it also starts anywhere else. The
suffixes that can matter are dealt to buckets by content, then each bucket is sorted:

1. Every window has an anchor: its leftmost 50-gram of smallest hash. Equal windows have equal
   anchors at equal offsets, so windows are compared only inside the bucket of their anchor's
   hash. An anchor owns a run of window starts; the bytes of those windows are its chunk. One
   pass over the texts stores each under a row number, with (anchor hash, chunk hash, place) per
   run, about one per 75 bytes. Where a text repeats itself with a short period (a line of one
   sign), its runs have equal chunks one after another: those between the first and the last of
   such a stretch are repeated already and stored as one span.
2. Buckets with one run hold nothing repeated. Runs whose chunk occurs twice or more are
   repeated as a whole (exact copies and unchanged stretches end here, counted by partial
   aggregation: a group of copies of any size costs a few rows per task).
3. In buckets with several different chunks, one chunk of each kind is fetched and their
   suffixes are sorted, one block of buckets at a time (``BLOCK_BYTES``), by the difference
   cover method: suffixes are ordered by their first ``V`` bytes; long ties are resolved by
   the precomputed ranks of the cover sample (positions whose residue modulo ``V`` is in
   ``COVER``), because for any two positions some shift below ``V`` moves both into the
   sample. Neighbours in this order that agree on a whole window are repeated.
   Memory is bounded by the block; a bucket with more than ``MAX_KINDS`` chunks is not sorted
   in one task but compared window by window through a distributed aggregation.
4. Runs of repeated starts are united per text; texts with removals are read once more, by row
   number, so rows of equal id and text are never multiplied.

Work is done once per distinct text: a text that occurs twice or more is removed as a whole.
Hashes of 64 bits select buckets, and bucket and chunk hash together (128 bits) stand for equal
chunks; what differs is compared byte by byte, except in buckets of more than ``MAX_KINDS``
chunks, where hash and 128-bit hash of a window stand for its bytes.

Defined results: null and empty texts and texts under ``WINDOW`` bytes keep all their bytes;
repeated rows (and rows of equal text) remove each other; null ids are kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muniprop.llm.common import bounded, stage, table

WINDOW = 200
GRAM = 50
SPREAD = WINDOW - GRAM + 1  # grams in a window
SEGMENT = 1 << 17  # window starts treated at a time
PLACE_BITS = 18  # places inside a segment's text
BLOCK_BYTES = 4 << 20
MAX_KINDS = 4096
# FIXED VALUES: a perfect difference cover: every residue modulo 31 is a difference of two of these.
V = 31
COVER = (1, 5, 11, 24, 25, 27)

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse for one segment."""
    if not _POWERS:
        n = SEGMENT + WINDOW + 1
        for m in (MULTIPLIER, INVERSE):
            p = np.full(n, m, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of every GRAM bytes (modulo 2^64, by prefix sums)."""
    up, down = powers()
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    g = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    return g


def runs_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, first start, last start, anchor hash) of every run of window starts."""
    parts = []
    for base in range(0, len(raw) - WINDOW + 1, SEGMENT):
        text = raw[base : base + SEGMENT + WINDOW - 1]
        g = gram_hashes(text)
        starts = len(text) - WINDOW + 1
        low = np.uint64((1 << PLACE_BITS) - 1)
        key = (g & ~low) | np.arange(len(g), dtype=np.uint64)  # ties go to the left
        pad = -len(key) % SPREAD
        blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, SPREAD)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(behind[:starts], ahead[SPREAD - 1 : SPREAD - 1 + starts])
        place = (best & low).astype(np.int64)
        first = np.concatenate(([0], np.nonzero(place[1:] != place[:-1])[0] + 1))
        last = np.concatenate((first[1:] - 1, [starts - 1]))
        p = place[first]
        parts.append((p + base, first + base, last + base, g[p]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A run as one number: anchor place, starts before it, starts of the run less one."""
    return (place << 16) | ((place - first) << 8) | (last - first)


def unpack(q: int) -> tuple[int, int, int]:
    """(anchor place, first start, last start)."""
    place = q >> 16
    first = place - ((q >> 8) & 255)
    return place, first, first + (q & 255)


def inner(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which runs have the anchor hash and chunk hash of the run before and of the run after."""
    out = np.zeros(len(h), bool)
    like = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    out[1:-1] = like[1:] & like[:-1]
    return out


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, digest, n_bytes, text, h, c, q, own): one row per document with its runs; ``own``
    holds the stretches of runs left out (first start times 2^31, plus the starts after it)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest_of = xxhash.xxh3_64_intdigest
        for b in bounded(batches, 1, 8 << 20):
            digests, sizes, arrays = [], [], []
            lists: list[list[np.ndarray]] = [[], [], [], []]
            for t in b.column(1).to_pylist():
                raw = (t or "").encode()
                digests.append(hashlib.sha256(raw).digest())
                sizes.append(len(raw))
                place, first, last, h = runs_of(np.frombuffer(raw, np.uint8))
                spans = zip(first.tolist(), (last + WINDOW).tolist(), (place - first).tolist(), strict=True)
                c = np.fromiter((digest_of(raw[i:j], a) for i, j, a in spans), np.uint64, len(h))
                mid = inner(h, c)
                own = [int(first[i]) << 31 | int(last[j] - first[i]) for i, j in ranges(mid)] if mid.any() else []
                per_text = (h[~mid].view(np.int64), c[~mid].view(np.int64), pack(place, first, last)[~mid],
                            np.array(own, np.int64))
                for some, x in zip(lists, per_text, strict=True):
                    some.append(x)
            for some in lists:
                ends = np.cumsum([0, *map(len, some)])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(some))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), b.column(1), *arrays],
                names=["doc_id", "digest", "n_bytes", "text", "h", "c", "q", "own"],
            )

    return rows.mapInArrow(
        run,
        "doc_id bigint, digest binary, n_bytes bigint, text string, "
        "h array<bigint>, c array<bigint>, q array<bigint>, own array<bigint>",
    )


# ---------------------------------------------------------------- sorting one block of buckets


def word_at(text: np.ndarray, at: np.ndarray, size: int = 8) -> np.ndarray:
    """Big-endian number of ``size`` bytes at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | text[at + k]
    return out


def dense_rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by keys, the first one most significant."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        step[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


class CoverSample:
    """Ranks of the suffixes at the sample positions of a text, to a depth over WINDOW."""

    def __init__(self, text: np.ndarray, size: int):
        rounds = size // V + 1
        at = (np.arange(rounds)[:, None] * V + np.array(COVER)[None, :]).ravel()
        rank = dense_rank(*[word_at(text, at + k, 8 if k < 24 else V - 24) for k in (0, 8, 16, 24)])
        depth = V
        while depth < WINDOW:
            shift = depth // V * len(COVER)  # the sample position ``depth`` further on
            later = np.concatenate([rank[shift:], np.full(min(shift, len(rank)), -1, np.int64)])[: len(rank)]
            rank = dense_rank(rank, later)
            depth *= 2
        self.rank = rank
        index = {c: i for i, c in enumerate(COVER)}
        self.index = np.array([index.get(r, -1) for r in range(V)])
        # Smallest shift below V that moves both residues into the sample.
        self.shift = np.array([[next(d for d in range(V) if (a + d) % V in index and (b + d) % V in index) for b in range(V)] for a in range(V)])

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.rank[place // V * len(COVER) + self.index[place % V]]

    def compare(self, a: int, b: int) -> int:
        """Order of two suffixes that agree on their first V bytes."""
        d = int(self.shift[a % V, b % V])
        x, y = (int(self.rank[(p + d) // V * len(COVER) + self.index[(p + d) % V]]) for p in (a, b))
        return (x > y) - (x < y)


def repeated_starts(chunks: list[tuple[int, bytes, int, int]]) -> list[np.ndarray]:
    """For chunks (bucket, bytes, anchor offset, number of starts) of whole buckets: which
    starts of each begin a window that occurs at another start of the same bucket."""
    # Lay the chunks out with their anchors at multiples of V: equal windows then have equal
    # residues, and most long ties need one look at the sample each.
    place, offsets = V, []
    for _, raw, anchor, _ in chunks:
        offsets.append(place + (-(place + anchor) % V))
        place = offsets[-1] + len(raw)
    size = place
    text = np.zeros(size + WINDOW + 2 * V, np.uint8)
    for o, (_, raw, _, _) in zip(offsets, chunks, strict=True):
        text[o : o + len(raw)] = np.frombuffer(raw, np.uint8)
    counts = np.array([n for *_, n in chunks])
    starts = np.concatenate([np.arange(o, o + n) for o, n in zip(offsets, counts.tolist(), strict=True)])
    bucket = np.repeat(dense_rank(np.array([h for h, *_ in chunks], np.int64)), counts)
    head = dense_rank(bucket, *[word_at(text, starts + k, 8 if k < 24 else V - 24) for k in (0, 8, 16, 24)])
    # Only long ties can be repeated; the rest of the order is not needed further.
    tied = np.bincount(head)[head] > 1
    flags = np.zeros(len(starts), bool)
    if tied.any():
        sample = CoverSample(text, size)
        spot = np.nonzero(tied)[0]
        at, group = starts[spot], head[spot]
        own = sample.shift[at % V, at % V]
        order = np.lexsort((sample.at(at + own), at % V, group))
        at, group, spot = at[order], group[order], spot[order]
        # Ties across residues: the pairwise shift decides.
        mixed = np.nonzero((group[1:] == group[:-1]) & (at[1:] % V != at[:-1] % V))[0]
        for g in np.unique(group[mixed]):
            i, j = np.searchsorted(group, [g, g + 1])
            sub = sorted(range(i, j), key=cmp_to_key(lambda a, b: sample.compare(int(at[a]), int(at[b]))))
            at[i:j], spot[i:j] = at[sub], spot[sub]
        near = np.nonzero(group[1:] == group[:-1])[0]
        same = np.ones(len(near), bool)
        for k in range(0, WINDOW, 8):
            live = np.nonzero(same)[0]
            same[live] = word_at(text, at[near[live]] + k) == word_at(text, at[near[live] + 1] + k)
        flags[spot[near[same]]] = True
        flags[spot[near[same] + 1]] = True
    return np.split(flags, np.cumsum(counts)[:-1])


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (first, last)."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist(), strict=True))


MARKS = "rid bigint, first bigint, last bigint"


def sort_buckets(chunks: DataFrame) -> DataFrame:
    """Marks of the single chunks (copies = 1) of every bucket of ``chunks`` (h, copies, rid, q,
    raw). Rows come bucket by bucket; a block is closed between buckets."""
    dealt = chunks.repartition("h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, bucket = 0, None

        def done() -> pa.RecordBatch:
            found = repeated_starts([(h, raw, *shape(q)) for h, _, _, q, raw in block])
            out = []
            for (_, copies, rid, q, _), flags in zip(block, found, strict=True):
                if copies == 1:
                    first = unpack(q)[1]
                    out += [(rid, first + a, first + b) for a, b in ranges(flags)]
            cols = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["rid", "first", "last"])

        for b in bounded(batches, 4):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != bucket and size > BLOCK_BYTES:
                    yield done()
                    block, size = [], 0
                bucket = row[0]
                block.append(row)
                size += len(row[4])
        if block:
            yield done()

    return dealt.select("h", "copies", "rid", "q", "raw").mapInArrow(run, MARKS)


def shape(q: int) -> tuple[int, int]:
    """(anchor offset in the chunk, number of starts)."""
    place, first, last = unpack(q)
    return place - first, last - first + 1


def compare_windows(chunks: DataFrame) -> DataFrame:
    """The same marks for buckets of very many chunks: every window is a row (bucket, offset,
    128-bit hash) and repeated ones are found by aggregation, which no hot bucket can stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 4, 1 << 20):
            out: list[tuple] = []
            for h, copies, rid, q, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                place, first, last = unpack(q)
                for s in range(first, last + 1):
                    out.append((h, place - s, xxhash.xxh3_128_digest(raw[s - first : s - first + WINDOW]), copies, rid, s))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)],
                                             names=["h", "d", "w", "copies", "rid", "first"])

    rows = chunks.select("h", "copies", "rid", "q", "raw").mapInArrow(
        run, "h bigint, d bigint, w binary, copies bigint, rid bigint, first bigint"
    )
    rows = stage(rows, "sa-windows")
    twice = rows.groupBy("h", "d", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "d", "w")
    return rows.where("copies = 1").join(twice, ["h", "d", "w"]).select("rid", "first", F.col("first").alias("last"))


# ---------------------------------------------------------------- the whole operator


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_kinds: int = MAX_KINDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    s1 = stage(scan(docs, doc_id, text).withColumn("rid", F.monotonically_increasing_id()), "sa-runs")
    slim = s1.select("rid", "doc_id", "digest", "n_bytes")
    texts_once = stage(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("rid").alias("rid")), "sa-texts")
    runs = s1.select("rid", F.inline(F.arrays_zip("h", "c", "q")))
    # Buckets with two runs or more, and whether all their chunks are equal.
    shared = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    # Stored first: a join with the aggregate itself would keep its partitions, and a hot anchor
    # could not be split.
    shared = stage(shared.where("n > 1").select("h", (F.col("low") == F.col("high")).alias("alike")), "sa-shared")
    hits = stage(runs.join(shared, "h"), "sa-hits")
    kinds = stage(
        hits.where("not alike").groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "q")).alias("one")),
        "sa-kinds",
    )
    # Whole runs: chunks that occur twice or more.
    whole = hits.where("alike").select("rid", "q").unionByName(
        hits.where("not alike").join(kinds.where("copies > 1").select("h", "c"), ["h", "c"]).select("rid", "q")
    )
    first = F.shiftright("q", 16) - F.shiftright("q", 8).bitwiseAND(F.lit(255).cast("bigint"))
    whole = whole.select("rid", first.alias("first"), (first + F.col("q").bitwiseAND(F.lit(255).cast("bigint"))).alias("last"))
    # Stretches of equal runs: known from the texts alone.
    own = s1.select("rid", F.explode("own").alias("o")).withColumn("first", F.shiftright("o", 31))
    own = own.select("rid", "first", (F.col("first") + F.col("o").bitwiseAND(F.lit((1 << 31) - 1).cast("bigint"))).alias("last"))
    # Chunks to sort, fetched from their texts by row number.
    needs = kinds.select("h", "copies", "one.rid", "one.q").groupBy("rid").agg(F.collect_list(F.struct("h", "copies", "q")).alias("needs"))
    single = texts_once.where("copies = 1").select("rid")
    touched = hits.select("rid").distinct().join(single, "rid")
    wanted = needs.join(touched.withColumn("touched", F.lit(True)), "rid", "full")
    long = s1.where(F.col("n_bytes") >= WINDOW).select("rid", "text")
    fetched = stage(long.join(wanted, "rid").select("rid", "needs", "touched", "text"), "sa-fetched")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 2, 2 << 20):
            out: list[tuple] = []
            for rid, asked, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = t.encode()
                for n in asked:
                    _, lo, hi = unpack(n["q"])
                    out.append((n["h"], n["copies"], rid, n["q"], raw[lo : hi + WINDOW]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)],
                                             names=["h", "copies", "rid", "q", "raw"])

    chunks = fetched.where("needs is not null").select("rid", "needs", "text").mapInArrow(
        cut, "h bigint, copies bigint, rid bigint, q bigint, raw binary"
    )
    crowded = stage(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_kinds).select("h"), "sa-crowded")
    if crowded.limit(1).count():
        marks = sort_buckets(chunks.join(crowded, "h", "left_anti")).unionByName(
            compare_windows(chunks.join(crowded, "h", "left_semi"))
        )
    else:
        marks = sort_buckets(chunks)
    spans = whole.unionByName(own).unionByName(marks).join(single, "rid").groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    changed = fetched.where("touched").select("rid", "text").join(spans, "rid").select("rid", "spans", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 2):
            out: list[tuple] = []
            for rid, found, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw, kept, at, n = t.encode(), hashlib.sha256(), 0, 0
                removed = 0
                for a, z in united([(s["first"], s["last"] + WINDOW) for s in found]):
                    kept.update(raw[at:a])
                    removed, n, at = removed + z - a, n + 1, z
                kept.update(raw[at:])
                out.append((rid, removed, n, kept.hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)],
                                             names=["rid", "n_removed", "n_spans", "kept_sha256"])

    result = changed.mapInArrow(apply, "rid bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    known = texts_once.join(result, "rid", "left").drop("rid")
    nothing = hashlib.sha256(b"").hexdigest()
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    return slim.join(known, "digest").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def united(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Intervals [a, z) joined where they overlap or touch, in order."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents").select("doc_id", "text"))
