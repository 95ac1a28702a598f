"""Operator 4, token ids in a binary store with a minimal perfect hash index.

Documents are encoded where they are read (Arrow batches), dealt to shards by id ranges (the
range bounds are quantiles of the ids: one number per shard on the driver) and sorted inside
their shard. Each shard is written as a run of blocks of whole documents; a block holds the raw
little-endian ids and its own index, so it can be read without any other block:

  shard, block, n_docs, n_null, n_tokens, width   counts; bytes per id (2 or 4)
  payload   ids of the documents one after the other, each ended by the end id
  ends      uint64 per document: ids up to and with it, from the block's start
  keys      int64 per document with an id, in order (documents without id come first)
  pilots, slots   minimal perfect hash over the distinct keys: a key's bucket gives a pilot,
            key and pilot a slot without collisions; a slot holds (fingerprint, ordinal of
            the key's first document, number of its documents) as three uint32

The rows are Parquet (any store Spark can reach, Spark's commit protocol: a lost executor
leaves no half shard). A lookup reads one pilot and one slot and checks the fingerprint.

Encoding: words between single spaces and line breaks are encoded by the tokenizer once per
Python worker and remembered (at ``MAX_WORDS`` the ones seen least are forgotten), because the
pre-tokenizer always cuts before such a space, and between a letter or digit and punctuation; words
of letters are one piece to it and go straight to the tokenizer's model, punctuation behind them is another;
a text with any other white space is encoded whole. Results equal those of encoding each whole text (tested against it).

Defined results: null and empty texts hold only the end id; null ids come first; repeated ids
keep all their rows, next to each other, ordered by their encoded ids inside a shard; an empty table
gives an empty store; other columns are ignored. One id on very many rows is spread over the shards
whose bounds it fills, rows without id over leading shards of their own, in proportion to them.
"""

from __future__ import annotations

import codecs
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muniprop.llm.common import bounded, partitions, stage, stage_path, table

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
MAX_WORDS = 600_000  # words remembered by a worker's encoder
PIECE = 1 << 20  # bytes of texts encoded at a time
BLOCK_TOKENS = 1 << 20  # ids after which a block is closed (a longer document is a block)
# FIXED VALUES: code points with the Unicode property White_Space.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Rows(dict):
    """Numbers words in order of first sight."""

    def __init__(self, names: list[str] | None = None):
        self.names = names or []
        super().__init__(zip(self.names, range(len(self.names)), strict=True))

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.names.append(word)
        return row


MARK = "\x01"  # before a comma or stop that is split from its word; texts that hold it are odd
SPLIT = ",."  # one of these between a letter or digit and a space is a piece of its own


class Encoder:
    """Encodes texts with a tokenizer file, remembering words."""

    def __init__(self, path: str, end_id: int = END_ID, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model if cuts_at_letters(self.tokenizer) else None
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.type = np.dtype("<u2" if self.width == 2 else "<u4")
        self.end_id, self.max_words = end_id, max_words
        self.rows = Rows()
        self.glued = np.array([self.rows[w] for w in ("\n", *(MARK + p for p in SPLIT))])  # rows without a space before them
        self.kind = np.zeros(1024, np.int8)  # by row; 1: whole text must be encoded, 2: ends in a letter or digit
        self.hits = np.zeros(1024, np.int32)
        self.start = np.zeros(2048, np.int32)  # by 2 * row + (1: no space before the word)
        self.size = np.full(2048, -1, np.int32)
        self.ids = np.zeros(1 << 16, self.type)
        self.used = self.seen = 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), 16_384):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 16_384], add_special_tokens=False)]
        return out

    def pieces(self, texts: list[str]) -> list[list[int]]:
        """Ids of words of letters (with or without the space before them): the pre-tokenizer leaves
        each in one piece, so the tokenizer's model takes them as they are."""
        shown = codecs.charmap_decode("\n".join(texts).encode(), "strict", BYTE_CHARS)[0].split(BYTE_CHARS[0x0A]) if texts else []
        return [[k.id for k in found] for found in map(self.model.tokenize, shown)]

    def learn(self, codes: np.ndarray) -> None:
        """Encode words met for the first time in this form."""
        names = self.rows.names
        listed = codes.tolist()
        cores = [names[c >> 1].rstrip(TAIL) for c in listed]
        plain = [self.model is not None and c != "" and LETTERS.issuperset(c) for c in cores]
        one = iter(self.pieces([w if c & 1 else " " + w for w, c, p in zip(cores, listed, plain, strict=True) if p]))
        texts = [names[c >> 1] if c & 1 else " " + names[c >> 1] for c, p in zip(listed, plain, strict=True) if not p]
        rest = iter(self.whole([t[1:] if t[0] == MARK else t for t in texts]))
        found = [next(one) if p else next(rest) for p in plain]
        # What follows the letters is a piece of its own.
        ends = [names[c >> 1][len(w) :] if p else "" for c, w, p in zip(listed, cores, plain, strict=True)]
        tails = sorted({t for t in ends if t})
        tail = dict(zip(tails, self.whole(tails), strict=True))
        found = [f + tail[t] if t else f for f, t in zip(found, ends, strict=True)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), self.type, total)
        self.size[codes] = sizes
        self.start[codes] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Raw ids of each text with the end id."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                t = t.replace("\n", " \n ") + " "
                for p in SPLIT:
                    t = t.replace(p + " ", f" {MARK}{p} ")
                w = t.split(" ")
                w.pop()
                counts[i] = len(w)
                words += w
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        self.grow(rows)
        ends = np.cumsum(counts)
        begins = ends - counts
        # A line break, and what stands at its right or at a text's start, has no space before it.
        glued = np.isin(rows, self.glued)
        bare = glued.copy()
        bare[begins[counts > 0]] = True
        bare[1:] |= rows[:-1] == self.glued[0]
        odd = self.kind[rows] == 1
        # A split comma or stop needs a letter or digit at its left, inside the same text.
        stop = glued & (rows != self.glued[0])
        left = np.concatenate(([False], self.kind[rows[:-1]] == 2))[: len(rows)]
        left[begins[counts > 0]] = False
        odd |= stop & ~left
        code = 2 * rows + bare
        new = np.unique(code[(self.size[code] < 0) & ~odd])
        if len(new):
            self.learn(new)
        # Gather the ids of all regular words in order.
        sizes = np.where(odd, 0, self.size[code])
        total = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.ids[np.repeat(self.start[code] - total[:-1], sizes) + np.arange(total[-1])]
        stop_id = np.array([self.end_id], self.type).tobytes()
        spoiled = np.concatenate(([0], np.cumsum(odd)))
        spoiled = spoiled[ends] > spoiled[begins]
        slow = np.nonzero(spoiled)[0].tolist()
        direct = dict(zip(slow, self.whole([texts[i] for i in slow]), strict=True))
        a, b = total[begins].tolist(), total[ends].tolist()
        out = [
            (np.array(direct[i], self.type) if i in direct else flat[a[i] : b[i]]).tobytes() + stop_id for i in range(len(texts))
        ]
        if len(self.rows) > self.max_words:
            self.shrink()
        return out

    def grow(self, rows: np.ndarray) -> None:
        """Room for all rows; classifies new words and counts sights."""
        n = len(self.rows)
        if n > len(self.kind):
            self.kind = np.concatenate([self.kind, np.zeros(n, np.int8)])
            self.hits = np.concatenate([self.hits, np.zeros(n, np.int32)])
            self.start = np.concatenate([self.start, np.zeros(2 * n, np.int32)])
            self.size = np.concatenate([self.size, np.full(2 * n, -1, np.int32)])
        for row, word in enumerate(islice(self.rows.names, self.seen, None), self.seen):
            if row >= len(self.glued):
                self.kind[row] = 1 if not word or not ODD_SET.isdisjoint(word) else 2 if word[-1] in PLAIN_END else 0
        self.seen = n
        self.hits[:n] += np.bincount(rows, minlength=n).astype(np.int32)

    def shrink(self) -> None:
        """Forget the words seen least, so that at most half of the room stays taken."""
        n = len(self.rows)
        least = 2
        while (self.hits[:n] >= least).sum() > self.max_words // 2:
            least *= 2
        keep = self.hits[:n] >= least
        keep[: len(self.glued)] = True
        old = np.nonzero(keep)[0]
        codes = np.stack([2 * old, 2 * old + 1], axis=1).ravel()
        size, start = self.size[codes], self.start[codes]
        known = np.maximum(size, 0).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(known)))
        self.ids = self.ids[np.repeat(start - total[:-1], known) + np.arange(total[-1])]
        self.used = len(self.ids)
        self.ids = np.concatenate([self.ids, np.zeros(1 << 16, self.type)])
        self.start, self.size = total[:-1].astype(np.int32), size
        self.kind, self.hits = self.kind[old], self.hits[old] // 2
        names = [w for w, k in zip(self.rows.names, keep.tolist(), strict=True) if k]
        self.rows = Rows(names)
        self.seen = len(names)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """The encoder of this Python worker: its words serve the worker's later tasks too."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


ODD_SET = frozenset(SPACES + MARK)
# Letters and digits of ASCII and Latin-1: behind them punctuation always starts a new piece.
PLAIN_END = frozenset(c for c in map(chr, range(0x100)) if c.isascii() and c.isalnum() or c.isalpha())


# Letters of every Unicode version since 3.2: runs of them are one piece to the pre-tokenizer.
LETTERS = frozenset(c for c in map(chr, range(1 << 16)) if unicodedata.category(c)[0] == unicodedata.ucd_3_2_0.category(c)[0] == "L")
# Behind letters a run of these is the next piece (an apostrophe may begin a contraction).
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# FIXED VALUES: the characters that stand for bytes in a byte-level vocabulary.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(0x100) if b not in _SHOWN]
BYTE_CHARS = "".join(chr(b if b in _SHOWN else 0x100 + _OTHERS.index(b)) for b in range(0x100))


def cuts_at_letters(tokenizer) -> bool:
    """Whether a tokenizer is byte-level BPE that cuts texts into runs of letters and others, and does
    nothing else before its model."""
    from tokenizers import models, pre_tokenizers

    before, model = tokenizer.pre_tokenizer, tokenizer.model
    return (
        tokenizer.normalizer is None
        and isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
        and isinstance(model, models.BPE) and not model.dropout and not model.continuing_subword_prefix and not model.end_of_word_suffix
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BUCKET_KEYS = 4  # keys per bucket of the hash
STEP = np.uint64(0x9E3779B97F4A7C15)


def slot_of(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """Slots of keys under pilots (broadcast against each other)."""
    return (mix64(mix64(keys) ^ (pilots.astype(np.uint64) + np.uint64(1)) * STEP) % np.uint64(n)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys + STEP) % np.uint64(buckets)).astype(np.int64)


def fingerprint_of(keys: np.ndarray) -> np.ndarray:
    return (mix64(mix64(keys ^ STEP)) >> np.uint64(32)).astype("<u4")


def build_hash(keys: np.ndarray) -> np.ndarray:
    """Pilots (uint32 per bucket) that send the distinct uint64 ``keys`` to 0..n-1 one to one.
    Buckets are placed from the largest down, each with its first pilot that hits free slots."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    pilots = np.zeros(buckets, "<u4")
    b = bucket_of(keys, buckets)
    order = np.argsort(b, kind="stable")
    bounds = np.searchsorted(b[order], np.arange(buckets + 1))
    free = np.ones(n, bool)
    trial = np.arange(256, dtype=np.uint64)
    for i in np.argsort(bounds[:-1] - bounds[1:], kind="stable").tolist():
        own = keys[order[bounds[i] : bounds[i + 1]]]
        if not len(own):
            break
        for base in range(0, 1 << 31, 256):
            at = np.sort(slot_of(own[:, None], trial[None, :] + np.uint64(base), n), axis=0)
            good = free[at].all(axis=0) & (at[1:] != at[:-1]).all(axis=0)
            if good.any():
                j = int(np.argmax(good))
                pilots[i] = base + j
                free[at[:, j]] = False
                break
    return pilots


def find_keys(keys: np.ndarray, pilots: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Slot number of each key, -1 where the stored fingerprint differs."""
    if not len(slots):
        return np.full(len(keys), -1, np.int64)
    k = keys.astype(np.int64).view(np.uint64)
    at = slot_of(k, pilots[bucket_of(k, len(pilots))], len(slots))
    return np.where(slots[at, 0] == fingerprint_of(k), at, -1)


BLOCK_SCHEMA = (
    "shard int, block int, n_docs bigint, n_null bigint, n_tokens bigint, width int, first_key bigint, last_key bigint, "
    "payload binary, ends binary, keys binary, pilots binary, slots binary"
)


def make_block(shard: int, block: int, keys: list[int | None], raw: list[bytes], width: int) -> dict:
    """One block from documents in order (those without id first)."""
    ids = np.array([k for k in keys if k is not None], np.int64)
    ends = np.cumsum([len(r) // width for r in raw]).astype("<u8")
    distinct, first, copies = np.unique(ids, return_index=True, return_counts=True)
    k = distinct.view(np.uint64)
    pilots = build_hash(k)
    slots = np.zeros((len(k), 3), "<u4")
    if len(k):
        n_null = len(keys) - len(ids)
        slots[slot_of(k, pilots[bucket_of(k, len(pilots))], len(k))] = np.stack(
            [fingerprint_of(k), (first + n_null).astype("<u4"), copies.astype("<u4")], axis=1
        )
    return {
        "shard": shard, "block": block, "n_docs": len(keys), "n_null": len(keys) - len(ids), "n_tokens": int(ends[-1]),
        "width": width, "first_key": int(ids[0]) if len(ids) else None, "last_key": int(ids[-1]) if len(ids) else None,
        "payload": b"".join(raw), "ends": ends.tobytes(), "keys": ids.astype("<i8").tobytes(), "pilots": pilots.tobytes(),
        "slots": slots.tobytes(),
    }


class Block:
    """Reader of one block."""

    def __init__(self, row: dict):
        self.payload = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
        self.ends = np.frombuffer(row["ends"], "<u8").astype(np.int64)
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.pilots = np.frombuffer(row["pilots"], "<u4")
        self.slots = np.frombuffer(row["slots"], "<u4").reshape(-1, 3)
        self.n_null = row["n_null"]

    def document(self, ordinal: int) -> tuple[int, np.ndarray]:
        """Start inside the block and ids of a document by its place."""
        start = int(self.ends[ordinal - 1]) if ordinal else 0
        return start, self.payload[start : int(self.ends[ordinal])]

    def lookup(self, keys: np.ndarray) -> list[range]:
        """Places of the documents of each key (an empty range where the key is absent)."""
        at = find_keys(keys, self.pilots, self.slots)
        out = []
        for s in at.tolist():
            first, copies = (int(self.slots[s, 1]), int(self.slots[s, 2])) if s >= 0 else (0, 0)
            out.append(range(first, first + copies))
        return out


def shard_bounds(docs: DataFrame, doc_id: str, shards: int) -> tuple[int, list[int]]:
    """Number of leading shards for rows without id (in proportion to them; 0: they share the
    first shard), and the ids at which the other shards begin (all but the first): quantiles of
    the ids."""
    if shards < 2:
        return 0, []
    key = F.col(doc_id).cast("bigint")
    cuts = [i / shards for i in range(1, shards)]
    n, known, at = docs.agg(F.count(F.lit(1)), F.count(key), F.percentile_approx(key, cuts, 20_000)).first()
    empty = min(shards - 1, shards * (n - known) // max(1, n))
    # The shards that are left begin at evenly chosen ones of the quantiles.
    rest = shards - empty
    return empty, [at[i * shards // rest - 1] for i in range(1, rest)] if at else []


def encode_rows(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int, bounds: list[int], empty: int = 0) -> DataFrame:
    """(key, shard, width, ids) of every row. Rows of an id that fills several shards, or of none, are
    spread over them by the digest of their ids and, for equal rows of a task, by their number; so
    the same rows always give the same shards, in whatever order a task reads them."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = encoder_of(path, end_id), {}

        def spread(key: int, ids: bytes, width: int) -> int:
            name = (key, xxhash.xxh3_128_digest(ids))
            met[name] = met.get(name, -1) + 1
            return (zlib.crc32(ids) + met[name]) % width

        for b in bounded(batches, 1, PIECE):
            raw = encoder.encode(b.column(1).to_pylist())
            none = b.column(0).is_null().to_numpy(zero_copy_only=False).tolist()
            key = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
            shard = []
            for k, no_id, lo, hi, r in zip(key.tolist(), none, low.tolist(), high.tolist(), raw, strict=True):
                if no_id:
                    shard.append(spread(k, r, empty) if empty > 1 else 0)
                else:
                    shard.append(empty + (lo if lo >= hi - 1 else lo + 1 + spread(k, r, hi - lo)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(shard, pa.int32()), pa.array([encoder.width] * len(raw), pa.int32()), pa.array(raw, pa.binary())],
                names=["key", "shard", "width", "ids"],
            )

    return rows.mapInArrow(run, "key bigint, shard int, width int, ids binary")


def write_store(docs: DataFrame, store: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                end_id: int = END_ID, shards: int | None = None, block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode ``docs`` and write the store at ``store``; returns its path."""
    spark = docs.sparkSession
    shards = shards or partitions(spark)
    empty, bounds = shard_bounds(docs, doc_id, shards)
    rows = encode_rows(docs, doc_id, text, tokenizer or tokenizer_path(), end_id, bounds, empty)
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, keys, raw, size = None, 0, [], [], 0

        def done(width: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([make_block(shard, block, keys, raw, width)], schema=BLOCK_ARROW)

        width = 2
        for b in batches:
            for key, s, width, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if keys and (s != shard or size + len(ids) // width > block_tokens):
                    yield done(width)
                    block, keys, raw, size = block + 1, [], [], 0
                if s != shard:
                    shard, block = s, 0
                keys.append(key)
                raw.append(ids)
                size += len(ids) // width
        if keys:
            yield done(width)

    dealt.mapInArrow(pack, BLOCK_SCHEMA).write.parquet(store)
    return store


KEYS_A_GROUP = 1_000_000  # asked keys that meet a block at a time
FOUND = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64()))])
BLOCK_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64()),
     ("width", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("payload", pa.binary()), ("ends", pa.binary()),
     ("keys", pa.binary()), ("pilots", pa.binary()), ("slots", pa.binary())]
)


def block_starts(spark: SparkSession, store: str) -> DataFrame:
    """(shard, block, base): ids before each block. Sums run inside a shard, then over one row
    per shard."""
    b = spark.read.parquet(store).select("shard", "block", "n_tokens")
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = b.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    over = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    total = b.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("outside", F.coalesce(F.sum("n").over(over), F.lit(0)))
    return inside.join(total, "shard").select("shard", "block", (F.col("inside") + F.col("outside")).alias("base"))


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each found through its block's
    index; documents without id are read by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}
                block, out = Block(row), []
                distinct = np.unique(block.keys)
                places = [(None, range(block.n_null)), *zip(distinct.tolist(), block.lookup(distinct), strict=True)]
                for key, place in places:
                    if key is not None and not place:
                        raise ValueError(f"key {key} is not in the index of block {row['shard']}/{row['block']}")
                    for o in place:
                        start, ids = block.document(o)
                        out.append((key, row["shard"], row["block"], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                    names=["doc_id", "shard", "block", "start", "n_tokens", "ids_crc32"],
                )

    rows = spark.read.parquet(store).mapInArrow(
        run, "doc_id bigint, shard int, block int, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    starts = block_starts(spark, store)
    return rows.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "shard", "block"
    )


def answers(row: dict, ask: np.ndarray) -> list[dict]:
    """What a block holds of the asked keys."""
    block = Block(row)
    return [
        {"doc_id": int(k), "shard": row["shard"], "block": row["block"], "ids": block.document(o)[1].astype(np.int64).tolist()}
        for k, place in zip(ask.tolist(), block.lookup(ask), strict=True)
        for o in place
        if block.keys[o - block.n_null] == k
    ]


def lookup(spark: SparkSession, store: str, keys: list[int]) -> DataFrame:
    """(doc_id, shard, block, ids) of the documents with the given ids: only blocks whose key
    range holds one are read, and each is asked by its index."""
    wanted = sorted(set(keys))
    hold = F.lit(False)
    for k in wanted:
        hold = hold | ((F.col("first_key") <= k) & (F.col("last_key") >= k))
    ask = np.array(wanted, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}
                out = answers(row, ask)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    return spark.read.parquet(store).where(hold).mapInArrow(run, "doc_id bigint, shard int, block int, ids array<bigint>")


def asked_blocks(spark: SparkSession, store: str, keys: DataFrame, key: str) -> DataFrame:
    """(shard, block, asked): the distinct keys with every block whose key range holds them.

    Blocks are in key order over the whole store. A key's last block is the one that begins last at
    or before it, found by one sort of block heads and keys inside the shard (shards are found by
    their lowest keys, one number per shard on the driver); a block before that one holds the key
    only if it ends with it, which is an equi-join."""
    heads = spark.read.parquet(store).where("first_key is not null").select("shard", "block", "first_key", "last_key")
    lows = heads.groupBy("shard").agg(F.min("first_key").alias("low")).orderBy("shard").collect()
    names, low = np.array([r["shard"] for r in lows], np.int32), np.array([r["low"] for r in lows], np.int64)
    asked = keys.select(F.col(key).cast("bigint").alias("asked")).where("asked is not null").distinct()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy()
            at = np.searchsorted(low, k, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(names[at[at >= 0]]), pa.array(k[at >= 0])], names=["shard", "at"])

    lined = heads.select("shard", F.col("first_key").alias("at"), "block", F.struct("block", "last_key").alias("head"))
    lined = lined.unionByName(asked.mapInArrow(place, "shard int, at bigint"), allowMissingColumns=True)
    order = W.partitionBy("shard").orderBy("at", F.col("block").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    met = lined.withColumn("begun", F.last("head", True).over(order)).where("head is null and begun.last_key >= at")
    ended = heads.join(asked, F.col("last_key") == F.col("asked")).select("shard", "block", "asked")
    return met.select("shard", "begun.block", F.col("at").alias("asked")).unionByName(ended).distinct()


def lookup_table(spark: SparkSession, store: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, shard, block, ids) of the documents whose ids are in a table of any size. Each block
    that may hold one is asked by its index, at most about ``KEYS_A_GROUP`` keys at a time; repeated
    keys count once, null and absent ones find nothing."""
    hits = stage(asked_blocks(spark, store, keys, key), "store-asked")
    many = hits.groupBy("shard", "block").agg(F.ceil(F.count(F.lit(1)) / KEYS_A_GROUP).alias("parts"))
    part = F.pmod(F.xxhash64("asked"), F.col("parts")).alias("part")
    lists = hits.join(many, ["shard", "block"]).groupBy("shard", "block", part).agg(F.collect_list("asked").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}
                out = answers(row, np.array(row["asked"], np.int64))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    # Stored, so that its size is known when the join with the blocks is planned.
    blocks = spark.read.parquet(store).join(stage(lists.drop("part"), "store-lists"), ["shard", "block"])
    return blocks.mapInArrow(run, "doc_id bigint, shard int, block int, ids array<bigint>")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(spark, write_store(docs, stage_path(spark, "tokens")))
