"""Operator 5, quality rules: a short-circuit cascade ordered by rejection per cost.

Features are native Column expressions over the whole text. Rules are predicates over them.
``plan_cascade`` estimates each rule's cost (operations of its features over the texts of a hash
sample) and selectivity (rows it rejects of those that earlier rules leave) and orders the rules by
rejection per cost, alike on every run;
``cascade`` evaluates them in that order inside one CASE, so a row stops at its first hit.
The order never changes a verdict, only the work and the reported first rule.

Defined results: a null or empty text has no words and fails the base rules; repeated rows,
ties and null ids are judged row by row; an empty table gives an empty result; extra columns
are kept as they are (computed names get a leading underscore if one clashes).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from muniprop.llm.common import SPACES, WORD, fresh, table

SAMPLE_ROWS = 400  # expected rows of the hash sample on which cost and selectivity are estimated
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the feature names; ``needs`` the features it evaluates."""

    name: str
    rejects: str
    needs: tuple[str, ...]


# The base rules of the contract, then the method's own thresholds, set so that prose in
# languages written with blanks passes with a wide margin (Chinese, Japanese or Thai prose does not:
# its runs without blanks are longer than 15 characters, the bound that the SQL fixes): symbols on over half of the words, over half of the
# lines repeated, or an average word too short or too long for running text.
BASE_RULES = (
    Rule("too_few_words", "n_words < 50", ("n_words",)),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", ("n_words", "n_repeat_words")),
)
METHOD_RULES = (
    Rule("symbols", "2 * n_symbols > n_words", ("n_words", "n_symbols")),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", ("n_lines", "n_dup_lines")),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", ("n_words", "word_chars")),
)


def word_array(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def char_count_without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, ""))


# Positions of a text fit in 24 bits of a packed key (16.7 million windows); longer texts
# take the exact path for all their windows.
POSITION_BITS = 24


def repeated_word_count(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the same text.

    Pass 1 packs the upper 40 bits of each window's hash with its position and sorts the
    primitive array: equal neighbours are the only windows that can repeat. Pass 2 compares
    those windows exactly (as words, position last) and unites the covered word positions.
    Both passes stay inside the row, so a hot text or source changes nothing.
    """
    n = F.size(words)
    step = F.lit(1 << POSITION_BITS).cast("bigint")
    packed = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), POSITION_BITS)
            + i.cast("bigint"),
        )
    )

    def candidates(keys: Column) -> Column:
        high = lambda k: F.shiftright(k, POSITION_BITS)
        hits = F.filter(
            keys,
            lambda x, k: (high(x) == high(F.get(keys, k - 1))) | (high(x) == high(F.get(keys, k + 1))),
        )
        return F.transform(hits, lambda x: F.pmod(x, step).cast("int"))

    positions = F.when(n <= (1 << POSITION_BITS), _let(packed, candidates)).otherwise(F.sequence(F.lit(0), n - 3))
    windows = lambda p: F.array_sort(
        F.transform(
            p,
            lambda i: F.struct(
                F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")
            ),
        )
    )

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
        keep = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.sort_array(F.transform(keep, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    count = _let(positions, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(_let(_let(windows(p), repeated), covered)))
    return F.when(n < 4, F.lit(0)).otherwise(count).cast("bigint")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda variable over a one-item array)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feature_columns(text: Column) -> dict[str, Column]:
    """The features by name; each is evaluated only where it is used."""
    safe = F.coalesce(text, F.lit(""))
    words = word_array(text)
    lines = F.filter(F.split(safe, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": char_count_without(text, SPACES).cast("bigint"),
        "n_symbols": (F.char_length(safe) - char_count_without(text, SYMBOLS)).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": _let(words, repeated_word_count),
    }


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` plus all features; returns the frame and the column name of each feature."""
    w = fresh(docs.columns, "words")[0]
    base = docs.withColumn(w, word_array(F.col(text)))
    cols = feature_columns(F.col(text))
    names = dict(zip(cols, fresh([*docs.columns, w], *cols), strict=True))
    out = {names[k]: c for k, c in cols.items() if k not in ("n_words", "n_repeat_words")}
    out[names["n_words"]] = F.size(w).cast("bigint")
    out[names["n_repeat_words"]] = repeated_word_count(F.col(w))
    return base.withColumns(out).drop(w), names


def feature_work(text: Column, words: Column) -> dict[str, Column]:
    """Operations that a feature takes on one text, in characters read or written: a pattern that
    replaces reads and writes each, lines are split and asked, their set is hashed; windows hash
    three words each and are sorted. The words themselves are split once for all rules."""
    chars = F.char_length(F.coalesce(text, F.lit("")))
    n = F.size(words)
    work = {
        "n_words": F.lit(0), "word_chars": 2 * chars, "n_symbols": 2 * chars, "n_lines": 2 * chars, "n_dup_lines": chars,
        "n_repeat_words": 3 * chars + n * F.ceil(F.log2(n + F.lit(2))),
    }
    return {k: c.cast("bigint") for k, c in work.items()}


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules ordered by rejection per cost on a hash sample of about ``sample_rows`` rows (the only
    sampled step; it decides the order of evaluation, never a verdict).

    A rule's cost is the number of operations its features take on the sampled texts, so equal
    tables always give equal orders. One aggregation counts the rows of each pattern of hits; the
    next rule is the one that rejects most of the rows that are left per cost (ties: the cheaper,
    then the earlier rule)."""
    n = docs.count()
    if not n or not rules:
        return list(rules)
    sample = docs
    if n > sample_rows:
        keys = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
        sample = docs.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int((1 << 40) * sample_rows / n))
    sample = sample.select(F.col(text).cast("string").alias("t")).withColumn("w", word_array(F.col("t")))
    feats = feature_columns(F.col("t")) | {"n_words": F.size("w").cast("bigint"), "n_repeat_words": repeated_word_count(F.col("w"))}
    work = feature_work(F.col("t"), F.col("w"))
    needed = sorted({k for r in rules for k in r.needs})
    seen = sample.select(*[feats[k].alias(k) for k in needed], *[work[k].alias(f"work_{k}") for k in needed])
    hits = F.array(*[F.coalesce(F.expr(f"({r.rejects})"), F.lit(False)) for r in rules])
    found = seen.groupBy(hits.alias("hits")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"work_{k}").alias(k) for k in needed]).collect()
    cost = [sum(g[k] for g in found for k in r.needs) + sum(g["n"] for g in found) for r in rules]
    left, order = list(range(len(rules))), []
    while left:
        alive = [g for g in found if not any(g["hits"][i] for i in order)]
        rate = {i: sum(g["n"] for g in alive if g["hits"][i]) / max(1, cost[i]) for i in left}
        order.append(min(left, key=lambda i: (-rate[i], cost[i], i)))
        left.remove(order[-1])
    return [rules[i] for i in order]


def first_rule(rules: list[Rule], names: dict[str, str]) -> Column:
    """Name of the first rule that rejects, in cascade order; null if none does."""
    if not rules:
        return F.lit(None).cast("string")
    sql = " ".join(f"when {_named(r.rejects, names)} then '{r.name}'" for r in rules)
    return F.expr(f"case {sql} end")


def _named(sql: str, names: dict[str, str]) -> str:
    for k in sorted(names, key=len, reverse=True):
        if names[k] != k:
            sql = sql.replace(k, f"`{names[k]}`")
    return sql


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """All features, ``base_failed``, ``rejected_by`` (first rule of the cascade) and ``kept``."""
    order = plan_cascade(docs, rules, text)
    df, names = with_features(docs, text)
    base, by, kept = fresh(df.columns, "base_failed", "rejected_by", "kept")
    base_sql = " or ".join(f"({_named(r.rejects, names)})" for r in BASE_RULES)
    df = df.withColumn(base, F.expr(base_sql))
    df = df.withColumn(by, F.when(F.col(base), F.lit("base")).otherwise(first_rule(order, names)))
    return df.withColumn(kept, F.col(by).isNull())


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that pass, with their own columns only. The base rules and the method's
    rules run as one short-circuit filter: a cheap rejection spares the dear features."""
    order = plan_cascade(docs, (*BASE_RULES, *METHOD_RULES), text)

    def verdict(words: Column) -> Column:
        feats = feature_columns(F.col(text)) | {
            "n_words": F.size(words).cast("bigint"), "n_repeat_words": repeated_word_count(words),
        }
        out = F.lit(True)
        for r in reversed(order):
            hit = _let(F.struct(*[feats[k].alias(k) for k in r.needs]), _predicate(r))
            out = F.when(F.coalesce(hit, F.lit(False)), F.lit(False)).otherwise(out)
        return out

    # The words are bound as a lambda variable: a filter on a column would be pushed below its
    # definition and split the text again at every use.
    return docs.where(_let(word_array(F.col(text)), verdict))


def _predicate(r: Rule):
    """The rule's predicate over a struct of its features."""

    def rejects(f: Column) -> Column:
        return {
            "too_few_words": lambda: f["n_words"] < 50,
            "repeated_words": lambda: f["n_repeat_words"] * 100 > f["n_words"] * 50,
            "symbols": lambda: f["n_symbols"] * 2 > f["n_words"],
            "repeated_lines": lambda: f["n_dup_lines"] * 2 > f["n_lines"],
            "word_length": lambda: (f["word_chars"] < f["n_words"] * 2) | (f["word_chars"] > f["n_words"] * 15),
        }[r.name]()

    return rejects


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines"
    )


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept, n_lines
FROM b
"""
