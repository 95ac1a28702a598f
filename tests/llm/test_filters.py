"""Operators 1, 2, 5 and 10 against brute force and on edge cases."""

import html
import random
import re
import time
import zlib

import pytest

from muniprop.llm import html_extraction as H
from muniprop.llm import language_id as L
from muniprop.llm import quality_rules as Q
from muniprop.llm import url_filters as U
from muniprop.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    dup = len(lines) - len(set(lines))
    base = n < 50 or 100 * len(covered) > 50 * n
    kept = not (base or 2 * symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 15 * n)
    return n, chars, symbols, dup, len(covered), base, kept


def test_quality_edges(edge_docs, no_docs):
    out = Q.judge(edge_docs)
    got = out.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_kept").collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert tuple(r)[2:] == plain_quality(r["text"]), r["doc_id"]
    kept = Q.keep(edge_docs)
    assert kept.columns == edge_docs.columns
    expected = sorted(str(r["doc_id"]) for r in edge_docs.collect() if plain_quality(r["text"])[-1])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == expected
    assert Q.keep(no_docs).count() == 0 and Q.judge(no_docs).count() == 0


def test_quality_order_is_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([("%%% *** " * 60,)] * 30, "text string")
    order = Q.plan_cascade(docs, Q.METHOD_RULES)
    assert {r.name for r in order} == {r.name for r in Q.METHOD_RULES}
    assert order[0].name == "symbols"  # the only one that rejects here


def test_quality_order_is_the_same_on_every_run_and_puts_dear_weak_rules_last(spark):
    rng = random.Random(2)
    plain = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 4 + str(rng.randrange(10**6)) for _ in range(200)) for _ in range(900)]
    rows = [(i, t + (" %%%" * 150 if i % 3 == 0 else "")) for i, t in enumerate(plain)] + [(900, "x y z " * 100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    rules = (*Q.BASE_RULES, *Q.METHOD_RULES)
    orders = [[r.name for r in Q.plan_cascade(docs.repartition(n), rules, sample_rows=m)] for n, m in ((1, 400), (2, 400), (5, 400))]
    assert orders[0] == orders[1] == orders[2]
    assert orders[0][0] == "symbols"
    # The dear rule rejects one row, which a cheaper one rejects too.
    dear = Q.Rule("dear", "n_repeat_words > 250 and n_words < 320", ("n_words", "n_repeat_words"))
    order = [r.name for r in Q.plan_cascade(docs, (dear, *Q.METHOD_RULES), sample_rows=10_000)]
    assert order[0] == "symbols" and order[-1] == "dear"
    assert Q.plan_cascade(docs.where("false"), rules) == list(rules)


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, default))


@pytest.mark.parametrize("rules", [U.RULES, (("com/", "block"), ("a.com/x", "allow"), ("b.a.com/", "block"), ("org/a/b/", "block"), ("a.com/", "allow"))])
def test_urls_against_brute_force(spark, rules):
    rng = random.Random(3)
    hosts = ["a.com", "b.a.com", "B.A.com", "c.b.a.com", "xa.com", "org", "w.org", "example.net", "z.example.net", "example.com", "net", "", "a..com", "com."]
    urls = [None, "", "nothing", "http://", "x://a.com", "x://a.com?/x", "x://a.com#/x", "a://b://c.com/x"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y', '/en/1', '/de/', '/fr/z', '/a/b/c', '/a'])}{rng.choice(['', '?q=/x', '#t'])}" for _ in range(400)]
    rows = [(i // 2, u) for i, u in enumerate(urls)] + [(None, "http://a.com/x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").repartition(4)
    got = sorted(tuple(map(str, r)) for r in U.judge(df, U.rules_frame(spark, rules)).collect())
    assert got == sorted(tuple(map(str, (p, *plain_verdict(u, rules)))) for p, u in rows)
    assert U.judge(df.where("false"), U.rules_frame(spark, rules)).count() == 0


def test_url_oracle_shape(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: tuple(r)[1:] for r in U.op1_url_filters(spark, sf_dir).collect()}
    assert got == {r["page_id"]: plain_verdict(r["url"], U.RULES) for r in pages.collect()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Top of site</p></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="post-12 body"><h1>Head &amp; line</h1><p>First   block
with <b>bold</b> text &eacute;&#33;<p>Second<br>block<ul><li>one<li>two</ul><form><p>Sign up</p></form>
<div class="ad-7">Buy now</div><script>var x="</p>";</script></div><aside>Side</aside>
<section id="comments"><p>A very long reader comment that goes on and on and on and on and on for a while</p></section>
<div class="cookie-notice"><p>We use cookies</p></div><footer>&copy; 2020</footer></body></html>"""


def test_html_blocks():
    page = H.Page(PAGE)
    assert page.best_path()[0] == "html>body>div.body.post-"
    assert page.extract(page.best_path()[0]) == "Head & line\n\nFirst block with bold text \u00e9!\n\nSecond block\n\none\n\ntwo"


def test_html_consensus_and_edges(spark):
    odd = PAGE.replace('<div class="post-12 body">', '<div class="teaser"><p>' + "Much text of another kind. " * 40 + '</p></div><div class="post-3 body">')
    rows = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", PAGE), (3, "http://a.org/3", odd), (3, "http://a.org/3", odd),
            (8, "http://a.org/8", PAGE), (4, None, PAGE), (5, "http://b.org/", None), (6, "http://b.org/", ""), (None, "http://c.org", "<p>lone"), (7, "x", "&amp &lt;b&gt; a<b")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as path")
    got = {}
    for r in H.extract(df).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert len(got[3]) == 2 and got[3][0]["text"] == got[1][0]["text"] and got[3][0]["consensus"]
    assert got[4][0]["text"] == got[1][0]["text"]
    assert got[5][0]["text"] == "" and got[6][0]["text"] == "" and got[None][0]["text"] == "lone"
    assert got[7][0]["text"] == "& <b> a<b"
    assert H.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("inner", [
    "<h1>{h}</h1><div class=body><p>{l}</p></div>",
    "<section class=intro><p>{s}</p></section><section class=details><p>{l}</p></section>",
    "<p>{s}</p><table><tbody><tr><td>{l}<td>{l}<tr><td>{l}</table><p>{h}</p>",
    "<p>{s}</p><ul><li>{l}<li>{l}</ul><p>{h}</p>",
])
@pytest.mark.parametrize("outer", ["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>", "{}"])
def test_html_keeps_what_stands_beside_the_best_container(inner, outer):
    said = {"h": "Title " * 10, "s": "Intro words. " * 30, "l": "Details of it. " * 70}
    source = inner.format(**said)
    links = "<div class=more>" + "<a href=/>Another page</a> " * 8 + "</div>"
    page = H.Page(f"<html><body><nav><a href=/>Home</a></nav>{outer.format(source)}{links}<footer>End</footer></body></html>")
    got = page.extract(page.best_path()[0])
    every = [" ".join(x.split()) for x in re.split(r"<[^>]*>", source) if x.strip()]
    assert [x for x in got.split("\n\n") if "Another" not in x] == every
    assert "Home" not in got and "End" not in got
    if outer != "{}":  # without a container of its own the article is the whole body
        assert "Another" not in got


def test_html_stays_inside_a_marked_article():
    page = H.Page("<body><div>Slogan of the site</div><article><h1>Title</h1><div><p>" + "Text. " * 99 + "</p></div></article></body>")
    assert page.extract(page.best_path()[0]) == "Title\n\n" + ("Text. " * 99).strip()


def test_html_on_the_table(spark, sf_dir):
    got = {r["page_id"]: r["text"] for r in H.op2_html_extraction(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner[1]) if inner else []
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_language_held_out(spark, sf_dir):
    docs = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    got = L.op10_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(edge_docs, no_docs):
    model = L.learn(edge_docs)
    got = {r["doc_id"]: r for r in L.predict(edge_docs, model).collect()}
    assert got[3]["lang_pred"] == "und" and got[4]["lang_pred"] == "und" and got[6]["lang_pred"] == "und"
    assert got[1]["lang_pred"] in model.languages
    assert L.predict(edge_docs, L.learn(no_docs)).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert L.predict(no_docs, model).count() == 0


PROSE = "Some long paragraph of prose with many words in it that goes on for quite a while. " * 4


def main_text(source):
    page = H.Page(source)
    best = page.best_path()
    return page.extract(best[0]) if best else ""


@pytest.mark.parametrize(
    "source", ["<a " * 350_000, '<a b="' * 170_000, "<p x='" * 170_000 + ">", "<" * 1_000_000, "<!--" * 250_000, "<script>" * 125_000, "<div>" * 200_000 + "x"]
)
def test_html_of_unclosed_parts_is_read_in_linear_time(source):
    start = time.perf_counter()
    main_text(source)
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize(
    "source",
    [
        f'<body><div class="content has-sidebar"><p>{PROSE}</p></div></body>',
        f'<body><article><p class="no-ads">{PROSE}</p></article></body>',
        f'<body><div data-id="comment-7"><p>{PROSE}</p></div></body>',
        f'<body><div data-class="menu" title="a class=menu"><p>{PROSE}</p></div></body>',
        f'<body><div class="search-results-wide footer"><p>x</p></div><div><p title=it\'s>{PROSE}</p></div></body>',
        f'<body><div class="share-prices-of-today sponsor-list"><p>{PROSE}</p></div></body>',
    ],
)
def test_html_marks_are_whole_words(source):
    assert main_text(source) == PROSE.strip()


def test_html_headings_keep_their_ids_and_boilerplate_goes():
    page = f'<article><h2 id="share-prices">Share prices</h2><p>{PROSE}</p><div id="comment-7"><p>{PROSE}</p></div><div class="page-footer">f</div></article>'
    assert main_text(page) == f"Share prices\n\n{PROSE.strip()}"


def test_html_without_article_leaves_slogans_out():
    body = f"<div class=story><h1>Title</h1><div class=text><p>{PROSE}</p><p>{PROSE}</p></div></div>"
    page = f"<html><body><div>The best paper in town</div>{body}<p>(c) 2020 The paper</p></body></html>"
    assert main_text(page) == f"Title\n\n{PROSE.strip()}\n\n{PROSE.strip()}"
    beside = f"<html><body><div class=story><div class=intro><p>{PROSE}</p></div><div class=text><p>{PROSE * 3}</p></div></div></body></html>"
    assert main_text(beside) == f"{PROSE.strip()}\n\n{(PROSE * 3).strip()}"


def test_html_hosts_vote(spark):
    """Two hosts without article: each page follows its host's layout, also one that looks otherwise."""
    def page(i, inner):
        return f"<html><body><div class=nav-top><a href=/>home</a></div><div class='{inner} n{i}'><p>{PROSE}</p><p>page {i}</p></div><div class=note><p>{'odd ' * (300 if i == 3 else 2)}</p></div></body></html>"

    rows = [(10 * h + i, f"http://h{h}.net/{i}", page(i, ("story", "text")[h])) for h in (0, 1) for i in range(6)]
    out = H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["text"] for r in out} == {f"{PROSE.strip()}\n\npage {i}" for i in range(6)}
    assert {r["path"] for r in out} == {"html>body>div.n.story", "html>body>div.n.text"} and all(r["consensus"] for r in out)
