"""Operators 3, 7 and 9 against brute force and on edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from muniprop.llm import decontamination as D
from muniprop.llm import simhash_dedup as S
from muniprop.llm import suffix_dedup as A
from muniprop.llm.common import connected_components, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_removals(texts, window=200):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - window + 1):
            s = b[i : i + window]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def texts_with_repeats(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(n) for n in (199, 200, 201, 260, 700)]
    out = [text(rng.randrange(0, 900)) for _ in range(20)]
    for _ in range(40):
        out.append(text(rng.randrange(0, 120)) + rng.choice(shared) + text(rng.randrange(0, 120)))
    base = text(3000)
    for _ in range(25):  # near copies: single edits everywhere
        t = list(base)
        for _ in range(rng.randrange(1, 12)):
            t[rng.randrange(len(t))] = "Z"
        out.append("".join(t))
    out += ["ab" * 400, "a" * 250, "a" * 200, "a" * 199, "é" * 150, "", None, base, base]
    return out


@pytest.mark.parametrize("max_kinds", [A.MAX_KINDS, 3])
def test_suffix_dedup_brute_force(spark, max_kinds):
    texts = texts_with_repeats(5)
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = sorted(tuple(map(str, r)) for r in A.removals(df, max_kinds=max_kinds).collect())
    expected = [(i if i % 7 else None, *e) for i, e in enumerate(plain_removals(texts))]
    assert got == sorted(tuple(map(str, e)) for e in expected)


def test_suffix_dedup_edges(edge_docs, no_docs):
    rows = edge_docs.collect()
    got = sorted(tuple(map(str, r)) for r in A.removals(edge_docs).collect())
    assert got == sorted(tuple(map(str, (r["doc_id"], *e))) for r, e in zip(rows, plain_removals([r["text"] for r in rows]), strict=True))
    assert A.removals(no_docs).count() == 0


def test_periodic_texts_are_stored_as_stretches(spark):
    rng = random.Random(8)
    odd = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = ["-" * 5000, odd(300) + "=" * 900 + odd(300) + "=" * 450, "ab" * 700 + odd(250), "Z" * 201, "Z" * 202,
             (odd(37) + "\n") * 40 + odd(400), (odd(180) + "|") * 12, odd(500) + " " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    runs = {r["doc_id"]: (len(r["h"]), len(r["own"])) for r in A.scan(df, "doc_id", "text").collect()}
    assert runs[0] == (2, 1) and runs[7][0] < 40
    got = sorted(tuple(map(str, r)) for r in A.removals(df).collect())
    assert got == sorted((str(i), *map(str, e)) for i, e in enumerate(plain_removals(texts)))


def test_rows_of_one_id_and_text_are_fetched_once(spark, monkeypatch):
    rng = random.Random(9)
    odd = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot = odd(600)
    near = [hot[:280] + "#" + hot[280:], hot[:350] + odd(200), odd(90) + hot[100:500]]
    rows = [(None, hot)] * 60 + [(7, hot)] * 30 + [(7, odd(400)) for _ in range(20)] + list(enumerate(near))
    rng.shuffle(rows)
    sizes = {}

    def watch(df, name, real=A.stage):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(A, "stage", watch)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(tuple(map(str, r)) for r in A.removals(df).collect())
    expected = [(i, *e) for (i, _), e in zip(rows, plain_removals([t for _, t in rows]), strict=True)]
    assert got == sorted(tuple(map(str, e)) for e in expected)
    assert sizes["sa-fetched"] <= len(near) + 8  # not once per copy


def test_long_text_is_cut_into_segments(monkeypatch):
    raw = np.frombuffer(("".join(random.Random(1).choice("abc") for _ in range(5000))).encode(), np.uint8)
    whole = A.runs_of(raw)
    monkeypatch.setattr(A, "SEGMENT", 700)
    cut = A.runs_of(raw)
    assert sum((whole[2] - whole[1] + 1)) == sum((cut[2] - cut[1] + 1)) == 4801
    spread = lambda r: [p for p, a, b in zip(*r[:3], strict=True) for _ in range(a, b + 1)]
    assert spread(whole) == spread(cut)  # every start keeps its anchor


def test_cover_sorts_mixed_residues():
    rng = random.Random(2)
    text = np.frombuffer(("".join(rng.choice("ab") for _ in range(40)) * 30).encode() + b"\0" * 300, np.uint8)
    sample = A.CoverSample(text, 1200)
    body = text.tobytes()
    for _ in range(300):
        a, b = rng.randrange(900), rng.randrange(900)
        if body[a : a + 31] == body[b : b + 31]:
            x, y = body[a : a + 248], body[b : b + 248]
            assert sample.compare(a, b) == (x > y) - (x < y)


def plain_fingerprint(text, k=3):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def plain_components(fps, ids, bits=3):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    out = [None] * n
    for members in groups.values():
        low = min((ids[m] for m in members if ids[m] is not None), default=None)
        for m in members:
            out[m] = low
    return out


def test_simhash_components_on_the_table(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op7_simhash_dedup(spark, sf_dir).collect()}
    fps = [plain_fingerprint(t) for _, t in docs]
    comp = plain_components(fps, [d for d, _ in docs])
    assert got == {d: (f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, comp, strict=True)}


def test_simhash_edges(edge_docs, no_docs):
    rows = edge_docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    comp = plain_components(fps, [r["doc_id"] for r in rows])
    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in S.components(edge_docs).collect())
    assert got == sorted((str(r["doc_id"]), f, str(c)) for r, f, c in zip(rows, fps, comp, strict=True))
    kept = S.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(c) for c in comp})
    assert S.components(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0


def test_keep_one_without_unique_ids(spark):
    """Null ids in several components, one id as the smallest of two, and an id on rows of a
    component that has a smaller one."""
    rng = random.Random(12)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(6))
    rows = [(None, a), (None, a), (None, b), (None, None), (5, c), (5, d), (6, d), (7, d), (5, e), (2, e), (9, f), (None, f)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, at int").repartition(4)
    kept = sorted(((r["doc_id"], r["text"]) for r in S.keep_one(df).collect()), key=repr)
    assert kept == sorted([(None, a), (None, b), (None, None), (5, c), (5, d), (2, e), (9, f)], key=repr)


def test_vantage_shards_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_POINTS", 40)
    monkeypatch.setattr(S, "LEAF", 8)
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:25]:
        for _ in range(30):
            x = b
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(3)
    roots = {r["node"]: r["root"] for r in connected_components(S.fingerprint_links(df)).collect()}
    comp = plain_components(fps, signed)
    groups = lambda label: sorted(sorted(f for f in signed if label[f] == v) for v in set(label.values()))
    assert groups({f: roots.get(f, f) for f in signed}) == groups(dict(zip(signed, comp, strict=True)))


def test_a_dense_ball_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_POINTS", 40)
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(300)}
    while len(fps) < 1500:
        x = center
        for bit in rng.sample(range(64), rng.choice((2, 3, 3, 3))):
            x ^= 1 << bit
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(3)
    _, leaves = S.build_tree(S.np.array(fps, S.np.uint64), 40, S.MAX_BITS)
    assert max(leaves) > 10 * 40  # the ball stays one leaf
    roots = {r["node"]: r["root"] for r in connected_components(S.fingerprint_links(df)).collect()}
    comp = plain_components(fps, signed)
    groups = lambda label: sorted(sorted(f for f in signed if label[f] == v) for v in set(label.values()))
    assert groups({f: roots.get(f, f) for f in signed}) == groups(dict(zip(signed, comp, strict=True)))
    # Each point meets each query in exactly one pair of blocks.
    fp, met = S.np.array(fps, S.np.uint64), {}
    for p, q, at, home in S.cells(7, fp, True):
        met.setdefault((p, q), ([], []))[0 if home else 1].extend(at.tolist())
    pairs = [(a, b) for (p, q), (home, asked) in met.items() for a in home for b in (asked if p != q else home) if p != q or a < b]
    assert len(pairs) == len({(min(x), max(x)) for x in pairs}) == len(fps) * (len(fps) - 1) // 2
    assert max(len(h) + len(a) for h, a in met.values()) < len(fps) / 2


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1400)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[j] == 1000 for j in range(1000, 1400))
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_matches(texts, items, window=10):
    wins = {}
    for name, t in items:
        w = BENCH_WORD.findall(lower(t))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("null" if name is None else str(name))
    sizes = {len(k) for k in wins}
    out = []
    for t in texts:
        w, hit, names = BENCH_WORD.findall(lower(t)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        out.append((len(w), len(hit), sorted(names)))
    return out


def plain_longest(text, items, window=10):
    """Longest of the matches that no equal word on either side continues, by item and word of it."""
    d, best = BENCH_WORD.findall(lower(text)), {}
    for name, t in items:
        w = BENCH_WORD.findall(lower(t))
        for j in range(len(w)):
            for i in range(len(d)):
                if i and j and d[i - 1] == w[j - 1]:
                    continue
                n = 0
                while i + n < len(d) and j + n < len(w) and d[i + n] == w[j + n]:
                    n += 1
                if n >= min(window, len(w)):
                    key = ("null" if name is None else str(name), tuple(w), j)
                    best[key] = min(best.get(key, (0, 0)), (-n, i))
    return sorted({(i, -n, name, j) for (name, _, j), (n, i) in best.items()})


def test_longest_matches_of_repeated_words():
    test = D.TestItems([("a", "x " * 300), ("b", "y x x z")], window=3)
    _, spans, items, longest = D.match_shard(["x " * 400 + "z", "q y x x z x x x", "", None], test)
    assert spans[0] == [(0, 401)] and spans[1] == [(1, 8)] and not spans[2] and not spans[3]
    assert items[:2] == [[0, 1], [0, 1]] and (1, 4, 1, 0) in longest[1] and (0, 300, 0, 0) in longest[0]
    names = [("a", "x " * 300), ("b", "y x x z")]
    for t, got in (("x " * 400 + "z", longest[0]), ("q y x x z x x x", longest[1])):
        assert [(a, n, test.names[i], j) for a, n, i, j in got] == plain_longest(t, names, 3)


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 25])
def test_decontamination_brute_force(spark, edge_docs, block_words):
    rng = random.Random(4)
    pool = "alpha Beta gamma, delta é1 x".split()
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((1, 3, 9, 10, 11, 14, 30))] + [(2, say(12)), (None, say(15)), (8, None), (9, " .,")]
    items += [(10, edge_docs.where("doc_id = 1").first()["text"][:200])]
    texts = [say(rng.randrange(0, 60)) for _ in range(60)] + [r["text"] for r in edge_docs.collect()]
    docs = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id bigint, text string").selectExpr("*", "1 as spans", "2 as items")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.find_matches(docs, bench, carry=("doc_id",), block_words=block_words).collect()
    plain = plain_matches(texts, items)
    size = lambda spans: sum(s["end"] - s["start"] for s in spans)
    assert sorted((r["doc_id"], r["n_words"], size(r["spans"]), list(r["items"])) for r in got) == sorted(
        (i % 50, *p) for i, p in enumerate(plain)
    )
    places = lambda r: [tuple(m) for m in r["longest"]]
    # Long texts without a match are left out of the plain search.
    assert sorted((r["doc_id"], r["n_words"], places(r)) for r in got) == sorted(
        (i % 50, p[0], plain_longest(t, items) if p[1] else []) for i, (t, p) in enumerate(zip(texts, plain, strict=True))
    )
    clean = D.remove_contaminated(docs, bench, block_words=block_words)
    assert clean.columns == docs.columns
    assert sorted(r["text"] or "" for r in clean.collect()) == sorted((t or "") for t, p in zip(texts, plain, strict=True) if not p[1])
    assert D.find_matches(docs, bench.where("false"), carry=("doc_id",)).where("size(items) > 0").count() == 0
    assert D.remove_contaminated(docs.where("false"), bench).count() == 0


def test_decontamination_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in D.op9_decontamination(spark, sf_dir).collect()}
    for r, (n, hit, names) in zip(docs, plain_matches([r["text"] for r in docs], items), strict=True):
        assert got[r["doc_id"]] == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
