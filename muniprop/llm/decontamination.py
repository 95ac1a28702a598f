"""Operator 9, benchmark decontamination by suffix arrays over the training text.

The training documents are indexed shard by shard (a shard is part of an Arrow
batch: whole documents of bounded total length): words become ids of the benchmark vocabulary, a
suffix array over the word positions is sorted, two words at a time, to the depth of a window, and
every suffix of every test item is located in it by binary search (equal suffixes once). Each place is
then extended along its item: the results are the maximal verbatim matches of at least a window
(``WINDOW`` words, or the whole of a shorter item) with their places in document and item, and spans,
the unions of all matched words of a document (a span may join matches of several items). The
array is sparse: a training position whose first two words never follow each other in any test item
cannot start a match of two words or more and is left out before the sort, so memory and time
follow the possible matches, not the corpus.

The test side is read in blocks of at most ``BLOCK_WORDS`` words, each a checked, bounded
broadcast; the driver holds one block at a time. Further blocks are further passes over the
documents, each stored before the next one's block is sent, so any benchmark size works.

Defined results: null and empty texts have no words, are never hit and never an item; items
with equal ids count once; a null item_id hits words under the name "null"; repeated document
rows are judged one by one; an empty benchmark hits nothing; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muniprop.llm.common import bounded, stage, table

WINDOW = 10
BLOCK_WORDS = 2_000_000  # words of test items held by a task at a time
# ASCII letters and digits (lower-cased) and every non-ASCII byte belong to words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


class TestItems:
    """One block of test items: vocabulary, words of all items one after the other (-1 before and
    after each), and the places of each distinct window in them, by the window's length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self.names = sorted({name for name, _ in items})
        place = {n: i for i, n in enumerate(self.names)}
        pairs, single, parts, starts, owner, at = set(), set(), [[-1]], [], [], 1
        for name, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            if not size:
                continue
            seen = self.by_length.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                seen.setdefault(tuple(ids[i : i + size]), []).append(at + i)
            pairs.update(zip(ids, ids[1:], strict=False))
            if size == 1:
                single.add(ids[0])
            starts.append(at)
            owner.append(place[name])
            parts.append([*ids, -1])
            at += len(ids) + 1
        self.words = np.fromiter(chain.from_iterable(parts), np.int64)
        self.starts, self.owner = np.array(starts, np.int64), np.array(owner, np.int64)
        self.base = len(self.ids) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        self.single = np.array(sorted(single), np.int64)

    def item_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the name and word number inside the item of places in ``words``."""
        row = np.searchsorted(self.starts, places, "right") - 1
        return self.owner[row], places - self.starts[row]


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``values`` occur in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class SuffixArray:
    """Sparse suffix array over word ids (0: a word of no test item, or a document's end),
    ordered by the first ``depth`` words."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, depth: int):
        self.ids = np.concatenate([ids, np.zeros(depth, ids.dtype)])
        rows = starts
        # Refine the order two words at a time; equal suffixes keep one rank.
        rank = np.zeros(len(rows), np.int64)
        base = int(ids.max(initial=0)) + 1
        for at in range(0, depth, 2):
            second = self.ids[rows + at + 1] if at + 1 < depth else 0
            key = self.ids[rows + at] * base + second
            order = np.lexsort((key, rank))
            new = np.empty(len(rows), np.int64)
            r, k = rank[order], key[order]
            step = np.concatenate(([0], ((r[1:] != r[:-1]) | (k[1:] != k[:-1])).astype(np.int64)))[: len(rows)]
            new[order] = np.cumsum(step)
            rank = new
            if len(rows) and rank.max() == len(rows) - 1:
                break
        self.suffixes = rows[np.argsort(rank, kind="stable")]
        self.first = self.ids[self.suffixes]

    def find(self, words: tuple[int, ...]) -> np.ndarray:
        """Positions whose suffix starts with ``words``: one binary search per word narrows
        the interval."""
        lo, hi = 0, len(self.suffixes)
        for k, w in enumerate(words):
            if lo == hi:
                break
            here = self.ids[self.suffixes[lo:hi] + k] if k else self.first
            lo, hi = lo + int(np.searchsorted(here, w, "left")), lo + int(np.searchsorted(here, w, "right"))
        return self.suffixes[lo:hi]


def extended(ids: np.ndarray, at: np.ndarray, test: TestItems, places: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, positions, lengths) of the maximal matches that begin with a window found at
    ``at`` in the documents and at ``places`` in the items: those that an equal word before does not
    make part of a longer one. Places are taken together by that word, so that repetitions do not
    multiply."""
    before, inside = ids[at - 1], test.words[places - 1]
    for word in np.unique(inside).tolist():
        begin = at[before != word]
        if not len(begin):
            continue
        for p in places[inside == word].tolist():
            length, alive, k = np.full(len(begin), size, np.int64), np.arange(len(begin)), size
            while len(alive):
                alive = alive[ids[begin[alive] + k] == test.words[p + k]]
                length[alive] += 1
                k += 1
            yield p, begin, length


def match_shard(texts: list[str | None], test: TestItems) -> tuple[np.ndarray, list[list[tuple]], list[list[int]], list[list[tuple]]]:
    """Per document of a shard: number of words, matched spans [start, end), items, and maximal
    matches (start, length, item, word number in the item)."""
    get = test.ids.get
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for d, t in enumerate(texts):
        words = words_of(t)
        sizes[d] = len(words)
        parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    nxt = np.concatenate([ids[1:], np.zeros(1, np.int64)])[: len(ids)]
    can = (ids > 0) & (((nxt > 0) & member(ids * test.base + nxt, test.pairs)) | member(ids, test.single))
    starts = np.nonzero(can)[0]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    longest: list[set[tuple[int, int, int, int]]] = [set() for _ in texts]
    if len(starts):
        array = SuffixArray(ids, starts, max(test.by_length, default=1))
        hits, ends = [], []
        for size, windows in test.by_length.items():
            for window, found in windows.items():
                at = array.find(window)
                if not len(at):
                    continue
                hits.append(at)
                ends.append(at + size)
                places = np.array(found, np.int64)
                names = set(test.item_at(places)[0].tolist())
                for d in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
                    items[d] |= names
                for p, begin, length in extended(array.ids, at, test, places, size):
                    # The longest match of a document from this word of the item, the first of equal ones.
                    doc = np.searchsorted(first, begin, "right") - 1
                    order = np.lexsort((begin, -length, doc))
                    one = order[np.unique(doc[order], return_index=True)[1]]
                    name, word = (int(x[0]) for x in test.item_at(np.array([p])))
                    for d, a, n in zip(doc[one].tolist(), (begin - first[doc])[one].tolist(), length[one].tolist(), strict=True):
                        longest[d].add((a, n, name, word))
        if hits:
            at, end = np.concatenate(hits), np.concatenate(ends)
            order = np.argsort(at, kind="stable")
            at, end = at[order], np.maximum.accumulate(end[order])
            new = np.concatenate(([True], at[1:] > end[:-1]))
            last = np.concatenate((np.nonzero(new)[0][1:] - 1, [len(at) - 1]))
            for a, b in zip(at[new].tolist(), end[last].tolist(), strict=True):
                d = int(np.searchsorted(first, a, "right")) - 1
                spans[d].append((a - int(first[d]), b - int(first[d])))
    return sizes, spans, [sorted(x) for x in items], [sorted(x) for x in longest]


MATCHES = (
    "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, "
    "longest array<struct<start:bigint,length:bigint,item:string,item_start:bigint>>"
)


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """Test items in blocks of at most ``block_words`` words (one longer item is a block)."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).cast("string").alias("t"))
    block, size = [], 0
    for r in rows.distinct().toLocalIterator():
        n = len(words_of(r["t"]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


def with_last(blocks: Iterator) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the only one."""
    held, alone = next(blocks), True
    for b in blocks:
        yield held, False
        held, alone = b, False
    yield held, alone


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: the ``carry`` columns, n_words, spans [start, end) of matched words
    (merged, in order), the names of the items that occur, and the ``longest`` matches: word number
    and length in the document, item, word number in the item. A match is maximal on both
    sides; of several from one word of an item the longest is named, of equal ones the first."""
    passes = []
    # With several passes, the text's digest tells rows with equal carried columns apart.
    tagged = docs.withColumn("__digest", F.md5(F.col(text).cast("string")))
    for block, alone in with_last(blocks_of(benchmark, item_id, item_text, block_words)):
        if alone:
            return search_pass(docs, text, block, window, carry)[0]
        found, sent = search_pass(tagged, text, block, window, (*carry, "__digest"))
        passes.append(stage(found, "decontamination-pass"))
        sent.destroy()
    return merge_passes(passes, (*carry, "__digest")).drop("__digest")


def search_pass(docs: DataFrame, text: str, block: list[tuple[str, str | None]], window: int, carry: tuple[str, ...]) -> tuple[DataFrame, Broadcast]:
    """Matches of one block of test items, and the block as it is sent."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields] + [MATCHES])
    rows = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast((block, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestItems(*sent.value)
        for b in bounded(batches, len(carry)):
            sizes, spans, items, longest = match_shard(b.column(len(carry)).to_pylist(), test)
            cols = [
                *b.columns[: len(carry)],
                pa.array(sizes),
                pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], SPAN_TYPE),
                pa.array([[test.names[i] for i in x] for x in items], pa.list_(pa.string())),
                pa.array([[{"start": s, "length": n, "item": test.names[i], "item_start": o} for s, n, i, o in x] for x in longest], MATCH_TYPE),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*carry, "n_words", "spans", "items", "longest"])

    return rows.mapInArrow(run, schema), sent


MATCH_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merge_passes(passes: list[DataFrame], carry: tuple[str, ...]) -> DataFrame:
    """Unite the matches of several test blocks. ``carry`` must name each row (repeated rows
    have equal matches and are told apart by their count)."""
    tagged = [p.withColumn("pass", F.lit(i)) for i, p in enumerate(passes)]
    every = reduce(DataFrame.unionByName, tagged)
    first = F.col("pass") == 0
    g = every.groupBy(*carry, "n_words").agg(
        F.sum(first.cast("bigint")).alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("longest")))).alias("longest"),
    )
    # Join spans that overlap or touch; they come in order of their start.
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, s):
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))
        return F.when((F.size(done) > 0) & (last["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    g = g.withColumn("spans", F.aggregate("all", start, add))
    g = g.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return g.select(*carry, "n_words", "spans", "items", "longest")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                        item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` without any matched window, in their own columns. Whole rows pass through
    the search, so nothing is joined back; each of several test blocks filters what is left, stored
    before the next one is sent."""
    place, names, out = docs.columns.index(text), docs.columns, docs
    for block, alone in with_last(blocks_of(benchmark, item_id, item_text, block_words)):
        sent = docs.sparkSession.sparkContext.broadcast((block, window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            test = TestItems(*sent.value)
            for b in bounded(batches, place):
                spans = match_shard(b.column(place).to_pylist(), test)[1]
                clean = b.filter(pa.array([not s for s in spans], pa.bool_()))
                yield pa.RecordBatch.from_arrays(clean.columns, names=names)

        out = out.mapInArrow(run, docs.schema)
        if not alone:
            out = stage(out, "decontamination-pass")
            sent.destroy()
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = find_matches(docs, table(spark, sf_dir, "benchmark"), carry=("doc_id",))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return m.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
