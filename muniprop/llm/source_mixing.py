"""Operator 6, mixing sources to target weights by hash-random keys and prefix sums.

Every document gets a hash-random key. Within its source the key space is cut into equal
ranges (about ``ROWS_PER_RANGE`` rows each: the keys are uniform, so no sampling is needed),
documents are sorted inside their range, and token counts are prefix-summed in two levels:
over ranges, then inside each range. Rows of equal id and text (one key) are counted per input
task first and enter the sums as one row, however many they are. A source's budget is spent in epochs: whole epochs take
every document, the last one is cut where the running sum is nearest to what is left. A hot
source is spread over as many ranges as it needs; only ids, sizes and keys are shuffled.

Defined results: a null or empty text has size 0; a null source is a source of its own, last
in order; a source without words has target 0 and takes nothing; repeated rows (same id, same
text) are separate rows of one key, of which a cut takes the right number;
null ids mix like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muniprop.llm.common import WORD, fresh, stage, table

SEED = "mix-1"
WEIGHTS = (3, 1, 2)  # by position of the source, repeating
BUDGET_PERCENT = 150  # of all sizes together
MAX_EPOCHS = 2  # no document is taken more often than this
ROWS_PER_RANGE = 4000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def random_key(doc_id: Column, text: Column) -> Column:
    """Uniform hash key of a document, the same on every run (32 hex digits); the text is part of
    it, so many rows of one id (or none) are spread unless their texts are equal too."""
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(SEED + ":"), name, F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of ``sizes`` (source, size, copies): source_size, n_rows, target.

    Water filling in closed form: with sources ordered by size per weight, the first ones are
    capped at ``max_epochs`` times their size and the rest share what is left by weight; the
    right number of capped ones is the smallest for which the next source is not above its
    cap. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(place - 1, len(weights)) + 1))
    cap = F.col("source_size") * max_epochs
    by_fill = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    per = per.select(
        "*",
        (F.sum("source_size").over(every) * percent / 100.0).alias("budget"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("cap_before"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    # Fill level if exactly the sources before this one are capped.
    per = per.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("w_left"))
    fits = F.col("level") * F.col("w") <= cap
    final = F.min(F.when(fits, F.struct((F.col("source_size") / F.col("w")).alias("r"), F.col("cap_before").alias("c"),
                                        F.col("level").alias("level")))).over(every)
    return per.withColumn("final", final).select(
        "source", "source_size", "n_rows",
        F.coalesce(F.least(F.col("final.level") * F.col("w"), cap.cast("double")), cap.cast("double")).alias("target"),
    )


def plan_mix(rows: DataFrame, **options) -> DataFrame:
    """``rows`` (rid, key, source, size, copies) as one row per copy, with source_size, target,
    taken, whole ``epochs`` and ``again`` (in the last, partial one too).

    ``rows`` should be a staged table: it is read for the totals and for the prefix sums.
    """
    targets = source_targets(rows, **options)
    t = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.greatest(F.lit(1), F.ceil(F.col("n_rows") / ROWS_PER_RANGE)).cast("bigint").alias("n_ranges"),
    )
    t = stage(t, "mix-targets")
    r = rows.join(t, rows["source"].eqNullSafe(t["s"])).drop("s")
    unit = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(16**12)
    r = r.withColumn("rng", F.floor(unit * F.col("n_ranges")))
    all_size = F.col("size") * F.col("copies")
    whole = r.groupBy("source", "rng").agg(F.sum(all_size).alias("range_size"))
    w = W.partitionBy("source").orderBy("rng").rowsBetween(W.unboundedPreceding, -1)
    starts = whole.select(F.col("source").alias("s"), F.col("rng").alias("g"),
                          F.coalesce(F.sum("range_size").over(w), F.lit(0)).alias("range_start"))
    inside = W.partitionBy("source", "rng").orderBy("key", "rid", "size").rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumn("upto", F.sum(all_size).over(inside))
    r = r.join(starts, r["source"].eqNullSafe(starts["s"]) & (r["rng"] == starts["g"])).drop("s", "g")
    # The copies of a row follow one another; the last one ends where the row's sum ends.
    r = r.withColumn("back", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    end = F.col("range_start") + F.col("upto") - F.col("back") * F.col("size")
    size = F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - epochs * F.col("source_size")
    # In the last epoch a document counts if more than half of it lies before the cut.
    again = (size > 0) & (end - size / 2.0 < left)
    r = r.withColumns({"epochs": epochs.cast("bigint"), "again": again})
    taken = (F.col("epochs") + F.col("again").cast("bigint")) * size
    return r.withColumn("taken", taken).drop("rng", "upto", "range_start", "n_ranges", "copies", "back")


def sized_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(rid, key, source, size, copies), staged: the only pass over the texts. Equal rows of one input
    task are one row, so a row's copies are bounded by a task's rows, and a key has at most one
    row per task."""
    rows = docs.select(F.col(doc_id).alias("rid"), random_key(F.col(doc_id), F.col(text)).alias("key"),
                       F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
                       F.spark_partition_id().alias("part"))
    rows = rows.groupBy("rid", "key", "source", "size", "part").agg(F.count(F.lit(1)).alias("copies")).drop("part")
    return stage(rows, "mix-sizes")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed rows themselves: ``docs`` with each row repeated as often as it is taken.

    The cut is a position in (key, size) order, so the second pass over the texts needs one
    small row per source: whole epochs, the position of the last document of the partial
    epoch, and how many of the rows at exactly that position are taken.
    """
    plan = stage(plan_mix(sized_rows(docs, doc_id, text, source), **options).where("size > 0"), "mix-plan")
    spot = F.struct("key", "size")
    per = plan.groupBy("source").agg(F.min("epochs").alias("epochs"), F.max(F.when(F.col("again"), spot)).alias("cut"))
    per = stage(per, "mix-spots")
    s, epochs, key, size, at_cut, n, m, place = fresh(
        docs.columns, "mix_source", "mix_epochs", "mix_key", "mix_size", "mix_at", "mix_n", "mix_m", "mix_place"
    )
    # Rows at exactly the cut: all of them, and those that are taken.
    here = plan.join(per.where("cut is not null").select(F.col("source").alias("s2"), "cut"),
                     plan["source"].eqNullSafe(F.col("s2")) & (F.col("key") == F.col("cut.key")) & (F.col("size") == F.col("cut.size")))
    at = here.groupBy("s2").agg(F.sum(F.col("again").cast("bigint")).alias("at"), F.count(F.lit(1)).alias("of"))
    cuts = per.join(at, per["source"].eqNullSafe(at["s2"]), "left").select(
        F.col("source").alias(s), F.col("epochs").alias(epochs), F.col("cut.key").alias(key), F.col("cut.size").alias(size),
        F.when(F.col("at") < F.col("of"), F.col("at")).alias(at_cut),
    )
    cuts = stage(cuts, "mix-cuts")
    j = docs.join(cuts, docs[source].cast("string").eqNullSafe(cuts[s]))
    j = j.withColumn(m, word_count(F.col(text))).where(F.col(m) > 0)
    here, cut = F.struct(random_key(F.col(doc_id), F.col(text)), F.col(m)), F.struct(F.col(key), F.col(size))
    before = F.coalesce(here <= cut, F.lit(False))
    shared = F.coalesce((here == cut) & F.col(at_cut).isNotNull(), F.lit(False))
    rest = j.where(~shared).withColumn(n, F.col(epochs) + before.cast("bigint"))
    every = rest
    if cuts.where(F.col(at_cut).isNotNull()).limit(1).count():
        # A cut among equal rows takes the first of them in a numbering: by task over their stored
        # rows, with a sum over one small row per task, so no number of equal rows is one group.
        ties = stage(j.where(shared).withColumn(place, F.monotonically_increasing_id()), "mix-ties")
        part = F.shiftright(F.col(place), 33)
        counts = ties.groupBy(F.col(s).alias("s3"), part.alias("p3")).agg(F.count(F.lit(1)).alias("c3"))
        w = W.partitionBy("s3").orderBy("p3").rowsBetween(W.unboundedPreceding, -1)
        counts = stage(counts.withColumn("before", F.coalesce(F.sum("c3").over(w), F.lit(0))), "mix-tie-counts")
        inside = F.row_number().over(W.partitionBy(s, part).orderBy(place))
        t = ties.withColumn(n, inside).join(counts, ties[s].eqNullSafe(F.col("s3")) & (part == F.col("p3")))
        t = t.withColumn(n, F.col(epochs) + (F.col("before") + F.col(n) <= F.col(at_cut)).cast("bigint"))
        every = rest.unionByName(t.drop(place, "s3", "p3", "c3", "before"))
    every = every.where(F.col(n) > 0)
    every = every.withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))))
    return every.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan_mix(sized_rows(docs)).select(
        F.col("rid").alias("doc_id"), "size", "source_size", "target", "taken"
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), p0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM d GROUP BY source
), p1 AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM p0
), p2 AS (
  SELECT *, source_size / w AS r, sum(source_size) OVER () * 150 / 100.0::DOUBLE AS budget,
    coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM p1
), p3 AS (
  SELECT *, (budget::DOUBLE - cap_before::DOUBLE) / w_left::DOUBLE AS level FROM p2
), lv AS (
  SELECT level FROM p3 WHERE level * w <= 2 * source_size ORDER BY r, cap_before LIMIT 1
), t AS (
  SELECT source, source_size, least((SELECT level FROM lv) * w, 2.0::DOUBLE * source_size) AS target FROM p3
), e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + (size > 0 AND upto::DOUBLE - size / 2.0::DOUBLE < target - epochs * source_size)::INT))::BIGINT AS taken
FROM e
"""
