"""Operators 4, 6 and 8 against brute force and round trips, and the pipeline as a whole."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from muniprop.llm import chat_format as C
from muniprop.llm import source_mixing as M
from muniprop.llm import token_store as T
from muniprop.llm.common import stage_path, table
from tests.llm.test_dedup import plain_components, plain_fingerprint, plain_matches
from tests.llm.test_filters import plain_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHOLE = []


def encode(texts):
    if not WHOLE:
        from tokenizers import Tokenizer

        WHOLE.append(Tokenizer.from_file(T.tokenizer_path()))
    return [WHOLE[0].encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


ODD = ["", None, "a", "a  b", "x\n\ny", " lead", "trail ", "tab\tx", "it's, they'll. 'quoted', don't!", "nb sp a", "x\x01, y",
       "<|endoftext|> x <|endoftext|>", "a<|endoftext|>, b", "é, ü! 12,5 3.4% foo_bar (x) [y].", "\n", "a\nb c\nd.", "!, ., a,, b,",
       "日本語 テスト。 x…, y", "\x1c x\x1fy", "ab́, c", "١٢, ٣", ", . ,", "a.\nb,\nc"]


def test_encoder_equals_whole_texts():
    rng = random.Random(7)
    pieces = ["the", " ", "  ", "\n", ", ", ". ", "Word", "'s", "é", "12", "!", "\t", "_", " ", "x1", "日本", "(", ")", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    e = T.Encoder(T.tokenizer_path(), 2, max_words=60)  # forgets all the time
    for i in range(0, len(texts), 97):
        part = texts[i : i + 97]
        assert [np.frombuffer(b, e.type).tolist() for b in e.encode(part)] == encode(part)


def test_minimal_perfect_hash():
    for n in (1, 2, 3, 50, 1000):
        keys = np.random.default_rng(n).choice(1 << 62, n, replace=False).astype(np.uint64)
        pilots = T.build_hash(keys)
        at = T.slot_of(keys, pilots[T.bucket_of(keys, len(pilots))], n)
        assert sorted(at.tolist()) == list(range(n))


def test_token_store_round_trip(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()] + list(enumerate(ODD, 20)) + [(2, f"copy {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as shard", "2 as block").repartition(4)
    store = T.write_store(df, stage_path(spark, "test"), shards=6, block_tokens=500)
    got = [tuple(r)[:4] for r in T.read_documents(spark, store).orderBy("start").collect()]
    ids = encode([t for _, t in rows])
    expected = {}
    for (d, _), x in zip(rows, ids, strict=True):
        expected.setdefault(d, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    found, pos = {}, 0
    for d, start, n, crc in got:
        assert start == pos
        pos += n
        found.setdefault(d, []).append((n, crc))
    assert [g[0] for g in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d or 0))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    asked = T.lookup(spark, store, [1, 5, 31, 999]).collect()
    plain = {}
    for (d, _), x in zip(rows, ids, strict=True):
        plain.setdefault(d, []).append(x)
    assert sorted((r["doc_id"], list(r["ids"])) for r in asked) == sorted((d, x) for d in (1, 5, 31) for x in plain[d])
    assert T.read_documents(spark, T.write_store(no_docs, stage_path(spark, "test"))).count() == 0


@pytest.mark.parametrize("group", [T.KEYS_A_GROUP, 3])
def test_token_store_lookup_by_a_table(spark, no_docs, monkeypatch, group):
    monkeypatch.setattr(T, "KEYS_A_GROUP", group)
    rows = [(3 * i - 60, f"text number {i}") for i in range(300)] + [(90, f"hot {i}") for i in range(150)] + [(None, "no id")] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    store = T.write_store(df, stage_path(spark, "test"), shards=7, block_tokens=60)
    asked = [None, 90, 90, *range(-70, 200), 836, 837, 838, 10**12, -(2**63), 2**63 - 1]
    keys = spark.createDataFrame([(k, "x") for k in asked], "asked bigint, block string").repartition(3)
    got = sorted((r["doc_id"], list(r["ids"])) for r in T.lookup_table(spark, store, keys, "asked").collect())
    ids = encode([t for _, t in rows])
    assert got == sorted((d, x) for (d, _), x in zip(rows, ids, strict=True) if d is not None and d in set(asked))
    places = [(r["shard"], r["block"], r["asked"]) for r in T.asked_blocks(spark, store, keys, "asked").collect()]
    heads = spark.read.parquet(store).where("first_key is not null").collect()
    plain = [(h["shard"], h["block"], k) for h in heads for k in set(asked) - {None} if h["first_key"] <= k <= h["last_key"]]
    assert sorted(places) == sorted(plain)
    assert T.lookup_table(spark, store, keys.limit(0), "asked").count() == 0
    assert T.lookup_table(spark, T.write_store(no_docs, stage_path(spark, "test")), keys, "asked").count() == 0


@pytest.mark.parametrize("hot", [None, 50])
def test_token_store_spreads_one_id(spark, hot):
    rows = [(i, f"text number {i}") for i in range(400)] + [(hot, "equal text")] * 200 + [(hot, f"hot {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    store = T.write_store(df, stage_path(spark, "test"), shards=10, block_tokens=60)
    got = T.read_documents(spark, store).orderBy("start").collect()
    ids = sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in encode([t for _, t in rows]))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == ids
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    shards = {}
    for r in got:
        shards[r["shard"]] = shards.get(r["shard"], 0) + 1
    assert len(shards) >= 9 and max(shards.values()) <= 3 * sorted(shards.values())[len(shards) // 2]
    # The same rows in another order and dealt alike lie in the same shards.
    again = T.read_documents(spark, T.write_store(df.sortWithinPartitions(F.desc("text")), stage_path(spark, "test"), shards=10, block_tokens=60))
    assert sorted(tuple(r) for r in again.groupBy("shard").count().collect()) == sorted(shards.items())
    lone = T.write_store(df.selectExpr("cast(null as bigint) as doc_id", "text"), stage_path(spark, "test"), shards=4)
    assert T.read_documents(spark, lone).count() == len(rows)


def plain_targets(sizes):
    """Targets by the iteration that the contract words."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_targets_and_cuts(spark, edge_docs, no_docs):
    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "a", "b", "B", "é", None, "z"])) for i in range(900)]
    rows += [(5, "w w w", "a")] * 30 + [(None, "q " * 9, "b")] * 4
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as size", "2 as target").repartition(5)
    sizes, biggest = {}, {}
    for _, t, s in rows:
        n = len(WORD.findall(t))
        sizes[s] = sizes.get(s, 0) + n
        biggest[s] = max(biggest.get(s, 0), n)
    target = plain_targets(sizes)
    plan = M.plan_mix(M.sized_rows(df)).collect()
    assert len(plan) == len(rows)
    taken = {}
    for r in plan:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(M.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {s: n for s, n in taken.items() if n}
    again = sorted((str(r["rid"]), r["taken"]) for r in M.plan_mix(M.sized_rows(df.repartition(3))).collect())
    assert again == sorted((str(r["rid"]), r["taken"]) for r in plan)
    assert M.mix(edge_docs).columns == edge_docs.columns and M.mix(edge_docs).count() > 0
    assert M.mix(no_docs).count() == 0 and M.plan_mix(M.sized_rows(no_docs)).count() == 0
    blank = edge_docs.where("doc_id in (3, 4)")
    assert M.mix(blank).count() == 0 and {r["taken"] for r in M.plan_mix(M.sized_rows(blank)).collect()} == {0}


def turn_digest(turns):
    return hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()


def test_mixing_spreads_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 50)
    rows = [(None if i % 3 == 0 else i, "w " * (1 + i % 7) + str(i), "a") for i in range(1200)]
    rows += [(None, "same text of six words here", "a")] * 600 + [(7, "b b", "b")] * 100
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    sized = M.sized_rows(df)
    # Different texts of no id have different keys; equal rows are at most one row per input task.
    assert sized.groupBy("key").count().agg({"count": "max"}).first()[0] <= 4
    plan = M.plan_mix(sized).collect()
    assert len(plan) == len(rows)
    sizes = {"a": sum(len(t.split()) for _, t, s in rows if s == "a"), "b": 200}
    target = plain_targets(sizes)
    taken = {s: sum(r["taken"] for r in plan if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= 4 for s in sizes)
    got = M.mix(df).groupBy("source").agg(F.sum(M.word_count(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == taken
    alike = spark.createDataFrame([(None, "one two three", "a")] * 501 + [(1, "x", "b")] * 11, "doc_id bigint, text string, source string")
    n = {r["source"]: r["taken"] for r in M.plan_mix(M.sized_rows(alike.repartition(5))).groupBy("source").sum("taken").toDF("source", "taken").collect()}
    mixed = M.mix(alike.repartition(5)).groupBy("source").count().collect()
    assert {r["source"]: r["count"] * (3 if r["source"] == "a" else 1) for r in mixed} == n


def test_chat_round_trip_and_edges(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\l \\\\ <turn user>\n", "", None, "a" * 200_000, "\\", "<", "x\\ny"]
    rows = [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "a>b\nc<", None]), nasty[(c + t) % len(nasty)]) for c in range(9) for t in range(c + 1)]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, None, "assistant", "first"), (None, 0, "assistant", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as node", "2 as depth", "3 as score")
    formatted = C.format_conversations(C.conversation_nodes(df)).cache()
    got = {r["conv_id"]: r for r in C.read_back(formatted).collect()}
    text = {r["conv_id"]: r["text"] for r in C.assemble(formatted).collect()}
    order = lambda r: tuple((v is not None, v if v is not None else "") for v in r[1:])
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), turn_digest(turns))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g["formatted_chars"] == len(text[c]) and text[c].count("</turn>") == len(turns)
    assert C.read_back(C.format_conversations(C.conversation_nodes(df.where("false")))).count() == 0


def test_reply_trees(spark):
    rng = random.Random(6)
    nodes = []
    for tree in range(12):
        for i in range(rng.randrange(1, 40)):
            nodes.append((f"{tree}-{i}", f"{tree}-{rng.randrange(max(0, i - 3), i)}" if i else None, float(rng.randrange(5))))
    nodes += [("lost", "absent", None), ("c1", "c2", 1.0), ("c2", "c1", 1.0), ("c3", "c1", 1.0)]
    parent = {n: p for n, p, _ in nodes}
    score = {n: s or 0.0 for n, _, s in nodes}

    def up(n):
        out = [n]
        while parent.get(out[-1]) in parent:
            out.append(parent[out[-1]])
        return out

    inner = {p for _, p, _ in nodes}
    best = {}
    for n in parent:
        if n not in inner and n[0] != "c":
            way = up(n)
            key = (-sum(score[x] for x in way), -len(way), n)
            best.setdefault(way[-1], []).append((key, way))
    df = spark.createDataFrame(nodes, "node string, parent string, score double")
    for keep in (1, 2):
        got = {}
        for r in C.paths(df, keep).collect():
            got.setdefault((r["root"], r["rank"]), []).append((r["depth"], r["node"]))
        expected = {}
        for root, ways in best.items():
            for k, (_, way) in enumerate(sorted(ways)[:keep], 1):
                expected[root, k] = list(enumerate(reversed(way)))
        assert {k: sorted(v) for k, v in got.items()} == expected


def test_chat_on_the_table(spark, sf_dir):
    convs = {}
    for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    convs[-7] = [("user", C.EXTRA_CONVERSATION), ("assistant", C.EXTRA_CONVERSATION)]
    got = {r["conv_id"]: r for r in C.op8_chat_format(spark, sf_dir).collect()}
    assert {c: (len(t), turn_digest(t)) for c, t in convs.items()} == {c: (r["n_turns"], r["turns_sha256"]) for c, r in got.items()}


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"], r["source"]) for r in table(spark, sf_dir, "documents").collect()))
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    docs = [d for d in docs if plain_quality(d[1])[-1]]
    comp = plain_components([plain_fingerprint(t) for _, t, _ in docs], [d for d, _, _ in docs])
    docs = [d for d, c in zip(docs, comp, strict=True) if d[0] == c]
    docs = [d for d, m in zip(docs, plain_matches([t for _, t, _ in docs], items), strict=True) if not m[1]]
    sizes, source = {}, {}
    for d, t, s in docs:
        source.setdefault(s, []).append((hashlib.md5(f"{M.SEED}:{d}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), d, len(WORD.findall(t))))
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    target, rows = plain_targets(sizes), []
    text = {d: t for d, t, _ in docs}
    for s, members in source.items():
        epochs, at = int(target[s] // sizes[s]), 0
        left = target[s] - epochs * sizes[s]
        for _, d, n in sorted(members):
            at += n
            rows += [d] * (epochs + (at - n / 2 < left))
    rows.sort()
    pos, expected = 0, []
    for d, ids in zip(rows, encode([text[d] for d in rows]), strict=True):
        expected.append((d, pos, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        pos += len(ids)
    got = sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(expected)


def test_stages_return_the_columns_of_documents(edge_docs, spark, sf_dir):
    docs = edge_docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = out


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == table(spark, sf_dir, "documents").columns and docs.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoder_numbers_words_alike_after_it_forgets_some():
    from muniprop.llm import token_store as T

    encoder = T.Encoder(T.tokenizer_path(), max_words=40)
    texts = [" ".join(f"w{i * j % 97}" for j in range(30)) for i in range(60)]
    got = [r for t in texts for r in encoder.encode([t])]
    assert encoder.rows.names == list(encoder.rows) and len(encoder.rows) <= 40 + 30
    plain = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert got == [T.np.array([*ids, T.END_ID], encoder.type).tobytes() for ids in plain]


def test_words_of_letters_equal_whole_texts():
    """Words of letters go to the tokenizer's model, with the ids that the tokenizer gives them."""
    encoder = T.Encoder(T.tokenizer_path())
    asked = []
    whole, encoder.whole = encoder.whole, lambda texts: asked.extend(texts) or whole(texts)
    words = ["Überschrift", "été", "the", "Щука", "漢字", "ªº", "a", "ﬁn", "ÿ", "Ġ"] + ["".join(p) for p in zip("abcdefgh", "ÄÖÜßéñçø", strict=True)]
    text = "\n".join([" ".join(words), " ".join(reversed(words)), "x2 don't ét ½ ²a"])
    plain = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode([text]) == [T.np.array([*plain, T.END_ID], encoder.type).tobytes()]
    assert asked and not {w.strip() for w in asked} & set(words)
    everything = ["".join(c) for c in T.LETTERS]
    singles = [e.ids for e in encoder.tokenizer.encode_batch_fast([" " + c for c in everything], add_special_tokens=False)]
    assert encoder.pieces([" " + c for c in everything]) == singles
    pairs = ["a" + c + "b" for c in everything]  # runs of letters are not cut
    assert encoder.pieces(pairs) == [e.ids for e in encoder.tokenizer.encode_batch_fast(pairs, add_special_tokens=False)]
    ended = [w + t for w in ("word", "été", "漢", "x2", "") for t in ("!!", "###", ";", "'s", "…", ".,", "_", "<|", "-a", "!'s")]
    text = " ".join(ended) + "\n" + "\n".join(ended)
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode([text]) == [T.np.array([*ids, T.END_ID], encoder.type).tobytes()]
