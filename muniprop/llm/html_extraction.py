"""Operator 2, main text of web pages by consensus host paths.

Pass 1 scores the containers of every page: a container is an element outside menus, headers,
footers, sidebars, adverts, notices, forms, scripts and comments; its score is the text of the
blocks below it that is not inside links, halved for every level between. The page votes for
the generalised tag-class path (digits cut from class names) of its best container, lifted to the
outermost article or main around it or, without one, to the highest container that adds a heading, or a
part of at least a fifth of the best container's length with under half of its text in links: such
parts belong to the article, slogans and copyright lines do not. Votes are
summed per host in Spark, and pass 2 extracts every page again with the winning path of its
host; a page without an element on that path uses its own best container.

Only (host, path, count) rows are shuffled. The winners are a staged table of one row per
host: Spark broadcasts it when its stored size is below its broadcast threshold and joins by
host otherwise (a hot host is split by the skew join).

Text: character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by an empty line; a page is always read whole.

Defined results: null or empty html and pages without text give an empty text; a null url has
an empty host of its own; repeated rows and null ids are extracted row by row; ties between
paths go to the path with more text, then to the first in order; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muniprop.llm.common import bounded, stage, table
from muniprop.llm.url_filters import host_of

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
# Elements that never hold main text, by tag and by word of their class, id or role.
OUT_TAGS = frozenset("head nav header footer aside form menu button select dialog search fieldset".split()) | RAW_TAGS
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup "
    "promo promoted reader-comments related reply replies search share sharing sidebar skip social sponsor sponsored subscribe "
    "toolbar widget alert complementary contentinfo".split()
)
CLOSES_P = BLOCK_TAGS - {"option", "optgroup", "body", "html", "legend", "summary", "figcaption"}
# A start of one of these closes an open sibling of the listed kinds.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
# First words that turn the rest of a class or id around ("no-ads", "has-sidebar").
NOT_IN = frozenset("has have is no non not with without hide hides hidden under".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SPACE = re.compile(r"[\s/]*")
KEY = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
NUMBERED = re.compile(r"[\d_-]*")
DEEPEST = 512  # nesting as browsers keep it; what opens below that counts as part of the element there
PART = 5  # a part beside the best container belongs to the article from a 5th of its length on
WHITE = re.compile(r"\s+")


class Element:
    """An open structural element: its generalised path and whether it is outside main text.
    ``guess`` says that only part of a class or id word says so."""

    __slots__ = ("tag", "path", "mark", "guess", "parent", "number")

    def __init__(self, tag: str, path: str, mark: bool, guess: bool, parent: Element | None, number: int):
        self.tag, self.path, self.mark, self.guess, self.parent, self.number = tag, path, mark, guess, parent, number

    @property
    def out(self) -> bool:
        e = self
        while e is not None:
            if e.mark:
                return True
            e = e.parent
        return False


def outside(word: str, is_id: bool) -> tuple[bool, bool]:
    """Whether a class, id or role word names boilerplate: as a whole, or by its first or last part
    (of an id, a slug as often as not, by the first part only before numbers: ``comment-7``)."""
    if word in OUT_WORDS:
        return True, False
    parts = [x for x in re.split(r"[-_]+", word) if x]
    if len(parts) < 2 or parts[0] in NOT_IN:
        return False, False
    first = parts[0] in OUT_WORDS and (not is_id or NUMBERED.fullmatch(word[len(parts[0]) :]) is not None)
    return first or parts[-1] in OUT_WORDS, True


def describe(tag: str, attributes: dict[str, str]) -> tuple[str, bool, bool]:
    """Generalised name of an element (tag and class words without digits), whether it is outside
    main text, and whether that is a guess."""
    classes = attributes.get("class", "").lower().split()
    name = ".".join([tag, *sorted(set(filter(None, (re.sub(r"\d+", "", w) for w in classes))))])
    if tag in OUT_TAGS:
        return name, True, False
    if tag in ("html", "body", "article", "main"):
        return name, False, False
    found = [outside(w, False) for w in (*classes, *attributes.get("role", "").lower().split())]
    if not (tag == "p" or tag[:1] == "h" and tag[1:].isdigit()):  # ids of headings and paragraphs are slugs
        found += [outside(w, True) for w in attributes.get("id", "").lower().split()]
    marks = [guess for out, guess in found if out]
    return name, bool(marks), bool(marks) and all(marks)


class Scanner:
    """Tags of a page from left to right, each character looked at a bounded number of times: what is
    not found once (a closing quote, a ``>``) is not looked for again."""

    def __init__(self, source: str):
        self.source, self.size = source, len(source)
        self.none: dict[str, bool] = {}

    def find(self, what: str, at: int) -> int:
        """Place of ``what`` from ``at`` on; -1 if there is none, as is then known for all later ones."""
        if self.none.get(what):
            return -1
        place = self.source.find(what, at)
        if place < 0:
            self.none[what] = True
        return place

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from ``at`` on, whether the tag closes itself, and the place after its ``>``
        (the end of the page if it has none)."""
        source, found = self.source, {}
        while True:
            space = SPACE.match(source, at)
            at = space.end()
            if at >= self.size:
                return found, False, self.size
            if source[at] == ">":
                return found, space.group().endswith("/"), at + 1
            key = KEY.match(source, at)
            at, value = key.end(), ""
            equals = EQUALS.match(source, at)
            if equals:
                at = equals.end()
                quote = source[at : at + 1]
                end = self.find(quote, at + 1) if quote in ('"', "'") else -1
                if end >= 0:
                    value, at = source[at + 1 : end], end + 1
                else:
                    bare = BARE.match(source, at)
                    value, at = bare.group(), bare.end()
            found.setdefault(key.group().lower(), html_module.unescape(value))


class Page:
    """Blocks of a page in order: (text, characters inside links, innermost element)."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, int, Element]] = []
        self.root = Element("", "", False, False, None, 0)
        self.open: list[Element] = [self.root]
        self.parts: list[str] = []
        self.in_link, self.link_chars, self.count = 0, 0, 0
        self.guesses: list[Element] = []
        if source:
            self.read(source)
            # A page without text outside boilerplate: marks that part of a word gave were wrong.
            if self.blocks and all(e.out for _, _, e in self.blocks):
                for e in self.guesses:
                    e.mark = False

    def flush(self) -> None:
        if self.parts:
            text = WHITE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((text, min(self.link_chars, len(text)), self.open[-1]))
            self.parts, self.link_chars = [], 0

    def text(self, raw: str) -> None:
        if raw:
            decoded = html_module.unescape(raw)
            self.parts.append(decoded)
            if self.in_link:
                self.link_chars += len(decoded.strip())

    def pop_to(self, place: int) -> None:
        self.flush()
        del self.open[place:]
        self.in_link = 0

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "a":
            self.in_link = 1
        if tag == "br":
            self.parts.append(" ")
        if tag not in BLOCK_TAGS and tag not in OUT_TAGS:
            return
        self.flush()
        closes = SIBLINGS.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            closes += ("h1", "h2", "h3", "h4", "h5", "h6")
        for place in range(len(self.open) - 1, 0, -1):
            kind = self.open[place].tag
            if kind in closes:
                self.pop_to(place)
            elif kind not in ("td", "th", "tr") or tag not in ("tr", "tbody", "tfoot"):
                break
        if tag in VOID_TAGS or len(self.open) >= DEEPEST:
            return
        name, mark, guess = describe(tag, attributes)
        above = self.open[-1]
        self.count += 1
        e = Element(tag, f"{above.path}>{name}" if above.path else name, mark, guess, above, self.count)
        if guess:
            self.guesses.append(e)
        self.open.append(e)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        if tag not in BLOCK_TAGS and tag not in OUT_TAGS:
            return
        for place in range(len(self.open) - 1, 0, -1):
            if self.open[place].tag == tag:
                self.pop_to(place)
                return
        self.flush()

    def read(self, source: str) -> None:
        at, size, scan, rest = 0, len(source), Scanner(source), 0
        while True:
            at = source.find("<", at)
            if at < 0:
                break
            after = source[at + 1 : at + 2]
            slash = after == "/"
            name = NAME.match(source, at + 1 + slash)
            if not name and after not in ("!", "?") and not slash:
                at += 1  # a plain "<"
                continue
            if name and scan.find(">", at) < 0:
                break  # no tag ends any more: what is left is text
            self.text(source[rest:at])
            if not name:
                comment = source.startswith("<!--", at)
                end = scan.find("-->" if comment else ">", at + (4 if comment else 2))
                at = rest = size if end < 0 else end + (3 if comment else 1)
                continue
            tag = name.group().lower()
            attributes, closed, at = scan.attributes(name.end())
            if slash:
                self.end(tag)
            elif tag in RAW_TAGS and not closed:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = close.end() if close else size
            else:
                self.start(tag, attributes)
            rest = at
        self.text(source[rest:])
        self.flush()

    def best_path(self) -> tuple[str, int] | None:
        """Path of the best container, lifted to the whole article, and its text's length."""
        score: dict[int, float] = defaultdict(float)
        chars: dict[int, int] = defaultdict(int)
        links: dict[int, int] = defaultdict(int)
        titled: dict[int, int] = defaultdict(int)
        at: dict[int, Element] = {}
        for text, linked, e in self.blocks:
            if e.out:
                continue
            heading = e.tag[:1] == "h" and e.tag[1:].isdigit()
            if heading:
                up = e.parent
                while up is not None:
                    titled[up.number] += 1
                    up = up.parent
            if heading or e.tag in ("p", "li", "td", "th", "pre", "blockquote", "dd", "dt", "figcaption"):
                e = e.parent or e
            share = float(len(text) - linked)
            while e is not None:
                at[e.number] = e
                score[e.number] += share
                chars[e.number] += len(text)
                links[e.number] += linked
                share /= 2
                e = e.parent
        if not score:
            return None
        top = max(score, key=lambda n: (score[n], n))
        # Up to the outermost article or main; without one, to the highest container that adds a part
        # (its own blocks, or a container in it) with under half of the text inside links that is a
        # heading or long enough: not a slogan or a copyright line.
        inside: dict[int, list[int]] = defaultdict(list)
        for n, e in at.items():
            if e.parent is not None:
                inside[e.parent.number].append(n)
        e = lifted = at[top]
        marked = e if e.tag in ("article", "main") else None
        while e.parent is not None:
            below, e = e.number, e.parent
            if e.tag in ("article", "main"):
                marked = e
            parts = [(chars[n], links[n]) for n in inside[e.number]]
            own = (chars[e.number] - sum(c for c, _ in parts), links[e.number] - sum(x for _, x in parts))
            beside = [own, *((chars[n], links[n]) for n in inside[e.number] if n != below)]
            if any(2 * x < c and c * PART >= chars[top] for c, x in beside) or titled.get(e.number, 0) > titled.get(below, 0):
                lifted = e
        best = marked or lifted
        return best.path, chars[best.number]

    def extract(self, path: str | None) -> str:
        """Blocks inside the elements on ``path`` (everything outside boilerplate for an empty
        path), as text."""
        out = []
        for text, _, e in self.blocks:
            if not e.out and (path == "" or e.path == path or (path and e.path.startswith(path + ">"))):
                out.append(text)
        return "\n\n".join(out)


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, pages, chars): the votes of each host."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            best = [Page(h).best_path() for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x and x[0] for x in best], pa.string()), pa.array([x and x[1] for x in best], pa.int64())],
                names=["host", "path", "chars"],
            )

    ballots = rows.mapInArrow(run, "host string, path string, chars bigint").where("path is not null")
    return ballots.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path with most votes of each host."""
    order = W.partitionBy("host").orderBy(F.col("pages").desc(), F.col("chars").desc(), "path")
    ranked = votes(pages, url, html).withColumn("k", F.row_number().over(order))
    return ranked.where("k = 1").select("host", "path")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, path, consensus) of every page; ``consensus`` says that the host's
    path was found on the page."""
    won = stage(winning_paths(pages, url, html), "html-paths").withColumnRenamed("host", "__host")
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.col(html).cast("string").alias("html"), host_of(F.col(url)).alias("host"),
    )
    rows = rows.join(won, F.col("host") == F.col("__host"), "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 2):
            texts, used, agreed = [], [], []
            for source, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                page = Page(source)
                text = page.extract(path) if path is not None else ""
                agreed.append(bool(text))
                if not text and (own := page.best_path()):
                    path = own[0]
                    text = page.extract(path)
                texts.append(text)
                used.append(path)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(used, pa.string()), pa.array(agreed, pa.bool_())],
                names=["page_id", "url", "text", "path", "consensus"],
            )

    return rows.mapInArrow(run, "page_id bigint, url string, text string, path string, consensus boolean")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
