"""Operators 11, 12 and 13 against brute force and on edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from muniprop.llm import centroid_clustering as C
from muniprop.llm import exact_dedup as D
from muniprop.llm import importance_resampling as I
from tests.llm.conftest import LONG, rows_of

SPACE = re.compile(r"[\x20\x09-\x0D]+")


# ---------------------------------------------------------------- operator 11


def plain_classes(rows):
    """[(doc_id, keep_id, group_size, kept, sha256)] of (doc_id, text) rows."""
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(SPACE.sub(" ", text or ""), []).append((doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for text, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], best[3], len(members), m is best, digest) for m in members]
    return out


def found_classes(docs, **options):
    return [(r[0], r[1], r[2], r[3], bytes(r[4]).hex()) for r in D.classes(docs, **options).collect()]


def test_classes_on_edge_rows(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    assert sorted(found_classes(edge_docs), key=repr) == sorted(plain_classes(rows), key=repr)
    assert found_classes(no_docs) == []
    kept = D.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    want = sorted((repr(d), SPACE.sub(" ", t or "")) for (d, t), c in zip_kept(rows) if c)
    assert sorted((repr(r["doc_id"]), SPACE.sub(" ", r["text"] or "")) for r in kept.collect()) == want
    assert D.deduplicate(no_docs).count() == 0


def zip_kept(rows):
    best = {}
    for i, (doc_id, text) in enumerate(rows):
        key = SPACE.sub(" ", text or "")
        best[key] = min(best.get(key, (True, math.inf, math.inf)), (doc_id is None, doc_id or 0, i))
    return [((d, t), best[SPACE.sub(" ", t or "")] == (d is None, d or 0, i)) for i, (d, t) in enumerate(rows)]


@pytest.mark.parametrize("digest_bytes", [1, 32])
def test_texts_decide_where_digests_collide(spark, digest_bytes):
    rng = random.Random(5)
    rows = [(i, f"text {rng.randrange(400)} of\t{rng.randrange(2)}") for i in range(1500)]
    rows += [(None, "text  7 of 1"), (7, "text 7\nof 1"), (7, "text 7\nof 1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = found_classes(docs, digest_bytes=digest_bytes)
    assert sorted(got, key=repr) == sorted(plain_classes(rows), key=repr)


def test_a_hot_class_is_salted_and_whole(spark):
    """Over a third of all rows have one text, half of those also one id."""
    base = spark.range(30_000)
    hot = "case when id % 3 = 0 then 'the  same text' else concat('text ', id) end"
    docs = base.selectExpr("case when id % 6 = 0 then 6 else id end as doc_id", f"{hot} as text").repartition(40)
    out = D.classes(docs)
    top = out.where("group_size > 1").groupBy("keep_id", "group_size").agg({"*": "count"}).collect()
    assert [tuple(r) for r in top] == [(3, 10_000, 10_000)]
    assert out.where("kept").count() == 20_001 and out.count() == 30_000


def test_salting_keeps_colliding_hot_texts_apart(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('t', cast(id % 2 as string)) as text").repartition(9)
    got = found_classes(docs, digest_bytes=0)  # every digest collides
    assert {(g[1], g[2]) for g in got} == {(0, 2000), (1, 2000)}
    assert sum(g[3] for g in got) == 2


# ---------------------------------------------------------------- operator 12


def plain_clusters(rows, k=8, rounds=10, dims=64, seed="3"):
    """[(vec_id, cluster, distance)] and the centroids, in Python integers."""
    kept = []
    for vec_id, e in rows:
        if e is None or len(e) != dims or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((vec_id, [math.floor(1024 * x) for x in e]))

    def name(v):
        return hashlib.sha256(f"{seed}:{'null' if v is None else v}".encode()).hexdigest()

    cents = [q for _, _, q in sorted((name(v), q, q) for v, q in kept)][:k]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        where = [near(q)[1] for _, q in kept]
        for i in range(len(cents)):
            mine = [q for (_, q), w in zip(kept, where, strict=True) if w == i]
            if mine:
                cents[i] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(v, near(q)[1], near(q)[0]) for v, q in kept], cents


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cluster string, distance string")


def rough(rng, scale=1.0, n=64):
    return [rng.uniform(-scale, scale) for _ in range(n)]


def test_clusters_on_edge_rows(spark):
    rng = random.Random(2)
    same = rough(rng)
    rows = [(i, rough(rng)) for i in range(60)]
    rows += [(i, same) for i in range(100, 140)] + [(3, same), (3, same), (None, same), (None, rough(rng))]
    rows += [(200, None), (201, []), (202, rough(rng, n=63)), (203, [None] * 64), (204, [math.nan] + same[1:]), (205, [math.inf] + same[1:])]
    rows += [(206, [0.0] * 64), (207, [-0.0] * 64), (208, [-1e-9] * 64), (209, rough(rng, 2e6)), (210, rough(rng, 1e9))]
    docs = vectors(spark, [(*r, "x", "y") for r in rows])
    want, cents = plain_clusters(rows)
    got, found = C.cluster(docs)
    assert found == cents
    assert sorted(map(repr, rows_of(got.selectExpr("vec_id", "cluster", "cast(coalesce(distance, far) as string)")))) == sorted(
        repr((v, c, str(d))) for v, c, d in want
    )
    described = C.described(got, found).collect()
    total = sum(d for *_, d in want)
    assert len(described) == len(want)
    assert {r["inertia"] for r in described} == {total if total < 2**63 else None}


def test_far_distances_are_exact_or_null(spark):
    rows = [(1, [1e12] * 64), (2, [-1e12] * 64), (3, [1e12] * 63 + [5.0]), (4, [1e15] * 64)]  # the last one is out of range
    got, cents = C.cluster(vectors(spark, [(*r, "x", "y") for r in rows]), k=1)
    want, plain = plain_clusters(rows[:3], k=1)
    assert cents == plain
    have = {r["vec_id"]: r["distance"] if r["far"] is None else int(r["far"]) for r in got.collect()}
    assert have == {v: d for v, _, d in want}
    assert all(r["distance"] is None and r["inertia"] is None for r in C.described(got, cents).collect())


def test_fewer_vectors_than_centroids_and_none(spark):
    rng = random.Random(3)
    rows = [(i, rough(rng), "x", "y") for i in range(3)]
    got, cents = C.cluster(vectors(spark, rows))
    assert len(cents) == 3 and all(r["distance"] == 0 for r in got.collect())
    got, cents = C.cluster(vectors(spark, rows).where("false"))
    assert cents == [] and C.described(got, cents).count() == 0
    assert C.described(got, cents).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_tournament_equals_search_with_ties():
    rng = np.random.default_rng(1)
    for _ in range(30):
        k, dims = rng.integers(1, 9), rng.integers(1, 5)
        c = rng.integers(-2, 3, (k, dims))
        x = rng.integers(-3, 4, (200, dims)).astype(np.int64)
        near, distance = C.Tournament(c.tolist()).nearest(x)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (near == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


# ---------------------------------------------------------------- operator 13

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low)


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(g.encode()) % 10_000 for g in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain_draw(docs, target):
    """[(doc_id, n_features, weight, score)] and the scores drawn, best first."""
    s, t = [0] * 10_000, [0] * 10_000
    for x in docs:
        for b in features_of(x[1]):
            s[b] += 1
    for x in target:
        for b in features_of(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10_000.0) / ((a + 1.0) * (sum(t) + 10_000.0)))) for a, b in zip(s, t, strict=True)]
    rows, able = [], []
    for doc_id, text in docs:
        f = features_of(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(f), weight, score))
        if len(words_of(text)) >= 20:
            able.append((-score, doc_id is None, doc_id or 0))
    return rows, sorted(able)[: 25 * len(able) // 100]


def check_draw(docs, target, texts, bench):
    rows, drawn = plain_draw(texts, bench)
    got = I.importance(docs, I.gains(docs, target)).collect()
    key = repr
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(rows, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == drawn
    return drawn


def test_draw_on_edge_rows(spark, edge_docs, no_docs):
    target = spark.createDataFrame([("quiet river bank",), (None,), ("Fox JUMPS over", )], "text string")
    bench = ["quiet river bank", None, "Fox JUMPS over"]
    texts = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    drawn = check_draw(edge_docs, target, texts, bench)
    taken = I.resample(edge_docs, target)
    assert taken.columns == edge_docs.columns
    assert sorted(repr(r["doc_id"]) for r in taken.collect()) == sorted(repr(None if n else d) for _, n, d in drawn)
    none = spark.createDataFrame([], "text string")
    assert I.importance(no_docs, I.gains(no_docs, target)).count() == 0 and I.resample(no_docs, target).count() == 0
    check_draw(edge_docs, none, texts, [])


def test_draw_cuts_among_repeated_rows(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(30))) for i in range(60)] + [(None, "z " * 25)] * 90 + [(5, "y " * 40)] * 50
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    target = spark.createDataFrame([("y y",)], "text string")
    drawn = check_draw(docs, target, texts, ["y y"])
    assert sorted(repr(r["doc_id"]) for r in I.resample(docs, target).collect()) == sorted(repr(None if n else d) for _, n, d in drawn)


def test_prefixes_give_the_crc_of_every_ngram():
    rng = random.Random(6)
    texts = [LONG, "", None, "  \n", "Ünïcödé ÑANDÚ x9", "one", "A" * 300 + " " + "b" * 70_000 + " c", "".join(chr(rng.randrange(1, 0x500)) for _ in range(900))]
    encoded = [None if t is None else t.encode() for t in texts]
    words, of, bucket = I.features(encoded)
    assert words.tolist() == [len(words_of(t)) for t in texts]
    for i, t in enumerate(texts):
        assert sorted(bucket[of == i].tolist()) == sorted(features_of(t))
    three = I.features([b"a b c d"], 1 << 32, 3)[2].tolist()
    assert sorted(three) == sorted(zlib.crc32(g) for g in (b"a", b"b", b"c", b"d", b"a b", b"b c", b"c d", b"a b c", b"b c d"))
