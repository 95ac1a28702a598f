"""Operator 10, language identification by hierarchical discrimination.

A text becomes a hashed profile of its byte trigrams (letters only, lower-cased, whole text).
Linear support vector machines first choose the language family (one against the rest); inside
a family of several languages one machine per pair votes, and the language with most votes
wins (ties: larger sum of margins, then code order). The score is the family's share of the
squashed family margins times the winner's mean squashed margin in its pairs.

Learning: at most ``PER_LANGUAGE`` labelled documents of each language, those with the lowest
hash of their id (a documented, bounded sample), become sparse profiles on the executors and
are fitted on the driver; the weights (``BUCKETS`` numbers per machine) are broadcast. Only the
text is an input of a prediction.

Defined results: a null text or one without a letter is ``und`` with score 0; without any
labelled document every text is ``und``; with one language it is that with score 1; a null id
counts as crc32 of the empty string and is never learned from; repeated rows and ties are
predicted row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muniprop.llm.common import bounded, table

PER_LANGUAGE = 250  # labelled documents of a language that are learned from
BUCKETS = 1 << 12
UNKNOWN = "und"
# Related languages; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr ne pa gu ur",
    "celtic": "ga cy br gd",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = re.compile(r"[^\W\d_]")
KEEP = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def profile(text: str) -> np.ndarray:
    """Hashed trigram profile of unit length: square roots of the trigrams' shares."""
    raw = KEEP[np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)]
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    code = code[(raw[1:-1] != 32) | (raw[:-2] != 32) & (raw[2:] != 32)]
    if not len(code):
        return np.zeros(BUCKETS, np.float32)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
    count = np.bincount(bucket, minlength=BUCKETS).astype(np.float32)
    return np.sqrt(count / count.sum())


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge loss, classes of
    equal total weight) by accelerated gradient descent. y is -1 or 1."""
    used = np.nonzero(x.any(axis=0))[0]
    a = np.hstack([x[:, used], np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(a.shape[1], np.float32)
    ahead, step = w.copy(), 1.0 / (2 * 2 + penalty)  # rows have squared length 2
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (a @ ahead))
        new = ahead - np.float32(step) * (np.float32(penalty) * ahead - 2 * a.T @ (share * y * slack))
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    full = np.zeros(x.shape[1] + 1, np.float32)
    full[used], full[-1] = w[:-1], w[-1]
    return full


class Model:
    """Families, their machines and the pair machines inside them."""

    def __init__(self, languages: list[str], x: np.ndarray, labels: np.ndarray):
        self.languages = languages
        self.family = [FAMILY_OF.get(re.split(r"[-_]", c.lower())[0], c) for c in languages]
        self.families = sorted(set(self.family))
        members = np.array([self.families.index(f) for f in self.family])[labels] if len(labels) else labels
        self.machines: list[np.ndarray] = []
        self.of_family: list[int] = []
        if len(self.families) > 1:
            for f in range(len(self.families)):
                self.of_family.append(len(self.machines))
                self.machines.append(fit_machine(x, np.where(members == f, 1.0, -1.0)))
        self.pairs: dict[str, list[tuple[int, int, int]]] = {f: [] for f in self.families}
        for a, b in combinations(range(len(languages)), 2):
            if self.family[a] == self.family[b]:
                rows = (labels == a) | (labels == b)
                self.pairs[self.family[a]].append((a, b, len(self.machines)))
                self.machines.append(fit_machine(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
        self.weights = np.stack(self.machines) if self.machines else np.zeros((0, BUCKETS + 1), np.float32)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) of each profile."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(x)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        sure = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        out = []
        for i in range(len(x)):
            family, part = self.families[0], 1.0
            if self.of_family:
                f = int(np.argmax(margin[i, self.of_family]))
                family, part = self.families[f], float(sure[i, self.of_family[f]] / sure[i, self.of_family].sum())
            mine = [j for j, f in enumerate(self.family) if f == family]
            if len(mine) == 1:
                out.append((self.languages[mine[0]], part))
                continue
            tally = {j: [0, 0.0, 0.0] for j in mine}  # votes, margins, squashed margins
            for a, b, m in self.pairs[family]:
                value = float(margin[i, m])
                tally[a if value >= 0 else b][0] += 1
                for j, v, s in ((a, value, float(sure[i, m])), (b, -value, 1 - float(sure[i, m]))):
                    tally[j][1] += v
                    tally[j][2] += s
            best = max(mine, key=lambda j: (tally[j][0], tally[j][1], -j))
            out.append((self.languages[best], part * tally[best][2] / (len(mine) - 1)))
        return out


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4).cast("int")


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out quarter."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    able = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("id")) != 2))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = able.select("id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    # At most PER_LANGUAGE ids of each language: a bounded broadcast.
    picked = able.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"]).where(F.col("text").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            found = [profile(t) for t in b.column(1).to_pylist()]
            at = [np.nonzero(p)[0].astype("<u2") for p in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([a.tobytes() for a in at]), pa.array([p[a].astype("<f4").tobytes() for p, a in zip(found, at, strict=True)])],
                names=["lang", "at", "value"],
            )

    sparse = picked.select("lang", "text").mapInArrow(run, "lang string, at binary, value binary")
    best = sparse.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("at", "value"))).where(F.col("k") <= per_language)
    got = best.select("lang", "at", "value").collect()
    languages = sorted({r["lang"] for r in got})
    x = np.zeros((len(got), BUCKETS), np.float32)
    labels = np.zeros(len(got), np.int64)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
        labels[i] = languages.index(r["lang"])
    return Model(languages, x, labels)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                texts = b.column(1).to_pylist()
                able = [bool(t and LETTER.search(t)) for t in texts]
                x = np.stack([profile(t) if ok else np.zeros(BUCKETS, np.float32) for t, ok in zip(texts, able, strict=True)])
                said = [v if ok else (UNKNOWN, 0.0) for v, ok in zip(sent.value.predict(x), able, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = predict(docs, learn(docs))
    return said.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
