"""Report operators over the ``properties`` table, for every municipality at once.

Each report groups by ``kommune_key`` (the SQL-form municipality key). A per-municipality
``LIMIT n`` becomes ``row_number() <= n`` inside the key, which Spark plans as a
``WindowGroupLimit`` that also runs map-side, so a municipality holding a third of all rows
never ships more than ``n`` rows per task through the shuffle.

"Share of total" windows only ever run over *grouped* frames (one row per municipality
and category/label/standard), whose size is bounded by the code domains, not by the data.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muniprop.functions.limits import bounded_limit
from muniprop.functions.scalars import (
    MISSING,
    age_band,
    age_band_order,
    duck_round,
    kommune_key,
    pct,
    problem_status,
    selected_key,
)

KEY = "kommune_key"
MAX_ROWS = 2000  # bound on any returned list
OCCUPANCY_MAX = 500

# FIXED VALUES: data-quality checks (field, label) in report order; the first five form the score.
QUALITY_FIELDS = [
    ("area_valid", "Valid Area (>0)"),
    ("address_present", "Address"),
    ("geo_present", "Lat/Lon"),
    ("utilities_present", "Water + Sewage"),
    ("heating_energy_present", "Heating/Energy"),
    ("status_present", "Building Status"),
    ("tek_present", "TEK Standard"),
]
SCORE_FIELDS = 5
QUALITY_GAP_BELOW = 90.0


def with_key(props: DataFrame) -> DataFrame:
    """Add ``kommune_key`` unless the table already carries it (stored tables do)."""
    return props if KEY in props.columns else props.withColumn(KEY, kommune_key("kommune"))


def for_kommune(props: DataFrame, name: str) -> DataFrame:
    """One municipality, ``norm(kommune) = norm(name)``; a plain equality on the stored
    key, so it prunes to one partition folder (the function form would not)."""
    value = str(name or "").strip()
    if not value:
        raise ValueError("kommune_name is required.")
    return with_key(props).where(F.col(KEY) == kommune_key(F.lit(value)))


def area() -> Column:
    return F.coalesce(F.col("bruksareal_totalt"), F.lit(0.0))


def address_label() -> Column:
    return F.coalesce(F.col("adresse"), F.col("adressenavn"), F.lit("-"))


def category_present() -> Column:
    c = F.col("forenklet_bygningskategori")
    return c.isNotNull() & (F.trim(c) != "")


def _by_key(*order: Column) -> Window:
    return Window.partitionBy(KEY).orderBy(*order)


def _top(df: DataFrame, n: int | None, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per municipality in the given order (map-side group limit); all of them,
    ranked, for ``None``."""
    ranked = df.withColumn(rank, F.row_number().over(_by_key(*order)))
    return ranked if n is None else ranked.where(F.col(rank) <= n)


def _key_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """Attach the per-municipality total of ``value``; ``df`` is already one row per group."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(KEY)))


# ---------------------------------------------------------------- grouped facts (one scan)

# dimension -> value expression; a municipality's rows are counted once per dimension.
def _dimensions() -> dict[str, Column]:
    return {
        "occupancy_category": F.when(category_present(), F.col("forenklet_bygningskategori")),
        "tek_standard": F.coalesce(F.col("tek_standard"), F.lit(MISSING)),
        "age_band": age_band("tek_standard"),
        "bygningsstatus": F.coalesce(F.col("bygningsstatus"), F.lit(MISSING)),
        "kommune": F.col("kommune"),
    }


def grouped_facts(props: DataFrame) -> DataFrame:
    """Counts and areas per (municipality, value) for every grouped report, in ONE scan.

    ``GROUPING SETS ((key, category), (key, standard), (key, band), (key, status),
    (key, label))``: one Expand + one partial/final aggregation replaces five separate
    scans and shuffles. Rows of the category set with no category (P02) are dropped.
    """
    dims = _dimensions()
    p = with_key(props).select(KEY, area().alias("_area"), *[v.alias(k) for k, v in dims.items()])
    sets = [[KEY, d] for d in dims]
    g = p.groupingSets(sets, KEY, *dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_area").alias("area"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    return g


def _facts_for(facts: DataFrame, dim: str, count_name: str) -> DataFrame:
    out = facts.where(F.col(f"_g_{dim}") == 0).select(
        KEY, F.col(dim), F.col("n").alias(count_name), F.col("area").alias("total_bruksareal")
    )
    return out.where(F.col(dim).isNotNull()) if dim == "occupancy_category" else out


# ---------------------------------------------------------------- K01 / K02 occupancy


def _occupancy_groups(props: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    if facts is not None:
        return _facts_for(facts, "occupancy_category", "building_count")
    return (
        with_key(props)
        .where(category_present())
        .groupBy(KEY, F.col("forenklet_bygningskategori").alias("occupancy_category"))
        .agg(F.count(F.lit(1)).alias("building_count"), F.sum(area()).alias("total_bruksareal"))
    )


def occupancy_distribution(props: DataFrame, limit: int = 30, facts: DataFrame | None = None) -> DataFrame:
    """Categories by area with their share of all categories (share before limit)."""
    limit = bounded_limit(limit, OCCUPANCY_MAX)
    g = _key_total(_occupancy_groups(props, facts), "total_bruksareal", "_all_area")
    g = g.withColumn("share_percent", pct("total_bruksareal", "_all_area"))
    return _top(g, limit, F.col("total_bruksareal").desc(), F.col("occupancy_category").asc()).select(
        KEY, "rank", "occupancy_category", "building_count", "total_bruksareal", "share_percent"
    )


def largest_occupancy(props: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The category with the largest summed area (count, then name break ties)."""
    g = _occupancy_groups(props, facts)
    return _top(
        g, 1, F.col("total_bruksareal").desc(), F.col("building_count").desc(), F.col("occupancy_category").asc()
    ).select(KEY, "occupancy_category", "total_bruksareal", "building_count")


# ---------------------------------------------------------------- fused per-municipality scan


def key_metrics(props: DataFrame) -> DataFrame:
    """One wide aggregation per municipality feeding K04, K18, K20, K22, K23 (one scan)."""
    p = with_key(props)
    a = area()
    subunits = F.coalesce(F.col("antall_underenheter"), F.lit(0))
    flags = [F.coalesce(F.col(c), F.lit(0)) == 1 for c in ("har_sefrakminne", "har_kulturminne", "skjermingsverdig")]

    def count_if(cond: Column) -> Column:
        return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")

    def nonblank(c: str) -> Column:
        return F.col(c).isNotNull() & (F.trim(F.col(c)) != "")

    return p.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_properties"),
        F.sum(a).alias("total_bruksareal"),
        count_if(flags[0]).alias("sefrak_count"),
        count_if(flags[1]).alias("kulturminne_count"),
        count_if(flags[2]).alias("skjermingsverdig_count"),
        count_if(flags[0] | flags[1] | flags[2]).alias("any_flag_total"),
        count_if(subunits > 0).alias("with_tenants_count"),
        F.sum(F.when(subunits > 0, a).otherwise(F.lit(0.0))).alias("with_tenants_area"),
        F.max(subunits).alias("max_underenheter"),
        count_if(F.coalesce(F.col("antall_eiere"), F.lit(0)) > 1).alias("multi_owner_count"),
        count_if(a > 0).alias("area_valid"),
        count_if(nonblank("adresse")).alias("address_present"),
        count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("geo_present"),
        count_if(F.col("vannforsynings_kode_id").isNotNull() & F.col("avlops_kode_id").isNotNull()).alias(
            "utilities_present"
        ),
        count_if(F.col("oppvarmings_kode_ids").isNotNull() | F.col("energikilde_kode_ids").isNotNull()).alias(
            "heating_energy_present"
        ),
        count_if(nonblank("bygningsstatus")).alias("status_present"),
        count_if(nonblank("tek_standard")).alias("tek_present"),
    )


# ---------------------------------------------------------------- K03 .. K08 exposure


def portfolio_totals(props: DataFrame) -> DataFrame:
    """Whole-table count and area (one row)."""
    return props.agg(
        F.count(F.lit(1)).alias("total_properties"), duck_round(F.coalesce(F.sum(area()), F.lit(0.0)), 1).alias("total_bruksareal")
    )


def selected_totals(props: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Per municipality count/area and their shares of the whole portfolio."""
    m = metrics if metrics is not None else key_metrics(props)
    everything = Window.partitionBy()  # over the per-municipality rows only
    m = m.withColumn("portfolio_total_properties", F.sum("total_properties").over(everything)).withColumn(
        "_portfolio_area", F.sum("total_bruksareal").over(everything)
    )
    return m.select(
        KEY,
        F.col("total_properties").alias("selected_properties"),
        duck_round("total_bruksareal", 1).alias("selected_bruksareal"),
        duck_round(
            F.lit(100.0) * F.col("total_properties") / F.greatest(F.col("portfolio_total_properties"), F.lit(1)), 2
        ).alias("property_share_percent"),
        duck_round(
            F.lit(100.0) * F.col("total_bruksareal") / F.greatest(F.col("_portfolio_area"), F.lit(1.0)), 2
        ).alias("area_share_percent"),
        "portfolio_total_properties",
        duck_round("_portfolio_area", 1).alias("portfolio_total_bruksareal"),
    )


def by_kommune(props: DataFrame, cap: int | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Raw labels of each municipality with shares of the whole portfolio."""
    if facts is not None:
        g = _facts_for(facts, "kommune", "property_count")
    else:
        g = (
            with_key(props)
            .groupBy(KEY, "kommune")
            .agg(F.count(F.lit(1)).alias("property_count"), F.sum(area()).alias("total_bruksareal"))
        )
    everything = Window.partitionBy()  # over (municipality, label) rows only
    g = g.withColumn("_pc", F.sum("property_count").over(everything)).withColumn(
        "_pa", F.sum("total_bruksareal").over(everything)
    )
    g = g.withColumn("property_share_percent", pct("property_count", "_pc")).withColumn(
        "area_share_percent", pct("total_bruksareal", "_pa")
    )
    g = g.withColumn("is_selected", selected_key("kommune") == selected_key(KEY))
    return _top(
        g, cap, F.col("total_bruksareal").desc(), F.col("property_count").desc(), F.col("kommune").asc_nulls_last()
    ).select(
        KEY, "rank", "kommune", "property_count", "total_bruksareal", "property_share_percent", "area_share_percent", "is_selected"
    )


def concentration(props: DataFrame, metrics: DataFrame | None = None, largest: DataFrame | None = None) -> DataFrame:
    """Area of the 5 and 10 largest properties and their share of the municipality.

    Derived from K07's ten largest rows when given (``largest``, ranked by area first): ties at
    the cut have equal area, so the tie-break does not change the sums, and no extra scan or
    shuffle is needed.
    """
    if largest is None:
        p = with_key(props).select(KEY, area().alias("a"))
        ranked = _top(p, 10, F.col("a").desc(), rank="rn")
    else:
        ranked = largest.where(F.col("rank") <= 10).select(KEY, F.col("total_bruksareal").alias("a"), F.col("rank").alias("rn"))
    top = ranked.groupBy(KEY).agg(
        F.sum(F.when(F.col("rn") <= 5, F.col("a")).otherwise(F.lit(0.0))).alias("top5"),
        F.sum("a").alias("top10"),
    )
    m = (metrics if metrics is not None else key_metrics(props)).select(KEY, "total_bruksareal")
    j = top.join(m, KEY)
    return j.select(
        KEY,
        duck_round("top5", 1).alias("top5_area"),
        F.coalesce(duck_round(pct("top5", "total_bruksareal"), 2), F.lit(0.0)).alias("top5_share_percent"),
        duck_round("top10", 1).alias("top10_area"),
        F.coalesce(duck_round(pct("top10", "total_bruksareal"), 2), F.lit(0.0)).alias("top10_share_percent"),
    )


def top_properties(props: DataFrame, top_n: int = 10, metrics: DataFrame | None = None) -> DataFrame:
    """The largest properties of each municipality with their area share."""
    top_n = bounded_limit(top_n)
    p = with_key(props).select(
        KEY,
        "kommune",
        "id",
        address_label().alias("address_label"),
        F.col("forenklet_bygningskategori").alias("occupancy_category"),
        F.coalesce(F.col("bygningsstatus"), F.lit(MISSING)).alias("bygningsstatus"),
        F.coalesce(F.col("tek_standard"), F.lit(MISSING)).alias("tek_standard"),
        area().alias("total_bruksareal"),
    )
    top = _top(p, top_n, F.col("total_bruksareal").desc(), F.col("address_label").asc(), F.col("id").asc())
    m = (metrics if metrics is not None else key_metrics(props)).select(KEY, F.col("total_bruksareal").alias("_ka"))
    return top.join(m, KEY).select(
        KEY,
        "rank",
        "kommune",
        "address_label",
        "occupancy_category",
        "bygningsstatus",
        "tek_standard",
        "total_bruksareal",
        pct("total_bruksareal", "_ka").alias("area_share_percent"),
    )


def _nest(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """Rank-ordered list of bounded rows per municipality (lists are capped by ``rank``)."""
    return df.groupBy(KEY).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col("rank"), *[F.col(f) for f in fields]))),
            lambda s: F.struct(*[s[f].alias(f) for f in ["rank", *fields]]),
        ).alias(name)
    )


def merge_on_key(frames: list[DataFrame]) -> DataFrame:
    """Combine per-municipality frames (one row per key each) without a join chain:
    stack them and take each column's single non-null value per key (one small shuffle)."""
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    cols = [c for c in stacked.columns if c != KEY]
    return stacked.groupBy(KEY).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def exposure_dashboard(
    props: DataFrame, top_n: int = 10, metrics: DataFrame | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """K04 + K06 scalars, K05 and K07 lists, one row per municipality."""
    m = metrics if metrics is not None else key_metrics(props)
    sel = selected_totals(props, m)
    largest = top_properties(props, top_n, m)
    conc = concentration(props, m, largest if top_n >= 10 else None)
    labels = _nest(
        by_kommune(props, facts=facts),
        "by_kommune",
        ["kommune", "property_count", "total_bruksareal", "property_share_percent", "area_share_percent", "is_selected"],
    )
    tops = _nest(
        largest,
        "top_properties_by_area",
        ["kommune", "address_label", "occupancy_category", "bygningsstatus", "tek_standard", "total_bruksareal", "area_share_percent"],
    )
    return merge_on_key([sel, conc, labels, tops])


# ---------------------------------------------------------------- K09 .. K11 occupancy mix


def occupancy_mix(props: DataFrame, limit: int = 30, facts: DataFrame | None = None) -> DataFrame:
    """Categories with count and area shares, largest area first."""
    limit = bounded_limit(limit)
    g = _key_total(_occupancy_groups(props, facts), "building_count", "_all_count")
    g = _key_total(g, "total_bruksareal", "_all_area")
    g = g.withColumn("count_share_percent", pct("building_count", "_all_count")).withColumn(
        "area_share_percent", pct("total_bruksareal", "_all_area")
    )
    return _top(g, limit, F.col("total_bruksareal").desc(), F.col("occupancy_category").asc()).select(
        KEY, "rank", "occupancy_category", "building_count", "total_bruksareal", "count_share_percent", "area_share_percent"
    )


def top_by_area(mix: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` rows of K09."""
    return mix.where(F.col("rank") <= n)


def top_by_count(mix: DataFrame, n: int = 10) -> DataFrame:
    """K09 rows re-sorted by count, then area, then K09 order; first ``n``."""
    w = _by_key(F.col("building_count").desc(), F.col("total_bruksareal").desc(), F.col("rank").asc())
    return mix.withColumn("count_rank", F.row_number().over(w)).where(F.col("count_rank") <= n)


# ---------------------------------------------------------------- K12 / K13 age and standard


def tek_distribution(props: DataFrame, cap: int | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Building-regulation mix ('MISSING' for null)."""
    if facts is not None:
        g = _facts_for(facts, "tek_standard", "property_count")
    else:
        g = (
            with_key(props)
            .groupBy(KEY, F.coalesce(F.col("tek_standard"), F.lit(MISSING)).alias("tek_standard"))
            .agg(F.count(F.lit(1)).alias("property_count"), F.sum(area()).alias("total_bruksareal"))
        )
    g = _key_total(_key_total(g, "property_count", "_c"), "total_bruksareal", "_a")
    g = g.withColumn("property_share_percent", pct("property_count", "_c")).withColumn(
        "area_share_percent", pct("total_bruksareal", "_a")
    )
    return _top(g, cap, F.col("total_bruksareal").desc(), F.col("tek_standard").asc()).select(
        KEY, "rank", "tek_standard", "property_count", "total_bruksareal", "property_share_percent", "area_share_percent"
    )


def age_bands(props: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Age bands from the regulation, in fixed band order."""
    if facts is not None:
        g = _facts_for(facts, "age_band", "property_count")
    else:
        g = (
            with_key(props)
            .groupBy(KEY, age_band("tek_standard").alias("age_band"))
            .agg(F.count(F.lit(1)).alias("property_count"), F.sum(area()).alias("total_bruksareal"))
        )
    g = _key_total(g, "total_bruksareal", "_a")
    return g.select(
        KEY,
        age_band_order("age_band").alias("band_order"),
        "age_band",
        "property_count",
        "total_bruksareal",
        pct("total_bruksareal", "_a").alias("area_share_percent"),
    )


# ---------------------------------------------------------------- K14 .. K17 status and large risks


def status_distribution(props: DataFrame, cap: int | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Building-status mix ('MISSING' for null)."""
    if facts is not None:
        g = _facts_for(facts, "bygningsstatus", "property_count")
    else:
        g = (
            with_key(props)
            .groupBy(KEY, F.coalesce(F.col("bygningsstatus"), F.lit(MISSING)).alias("bygningsstatus"))
            .agg(F.count(F.lit(1)).alias("property_count"), F.sum(area()).alias("total_bruksareal"))
        )
    g = _key_total(_key_total(g, "property_count", "_c"), "total_bruksareal", "_a")
    g = g.withColumn("property_share_percent", pct("property_count", "_c")).withColumn(
        "area_share_percent", pct("total_bruksareal", "_a")
    )
    return _top(g, cap, F.col("total_bruksareal").desc(), F.col("bygningsstatus").asc()).select(
        KEY, "rank", "bygningsstatus", "property_count", "total_bruksareal", "property_share_percent", "area_share_percent"
    )


def problem_statuses(status_dist: DataFrame) -> DataFrame:
    """Sorted distinct problem statuses of the status mix (pass it uncapped)."""
    from muniprop.functions.scalars import trim_ws

    s = status_dist.where(problem_status("bygningsstatus")).select(KEY, trim_ws("bygningsstatus").alias("bygningsstatus"))
    s = s.distinct()
    return s.withColumn("rank", F.row_number().over(_by_key(F.col("bygningsstatus").asc())))


def _detail(props: DataFrame, *more: Column) -> DataFrame:
    return with_key(props).select(
        KEY,
        "id",
        "kommune",
        address_label().alias("address_label"),
        F.col("forenklet_bygningskategori").alias("occupancy_category"),
        "bygningsstatus",
        "tek_standard",
        area().alias("total_bruksareal"),
        *more,
    )


def problem_properties(props: DataFrame, limit: int = 50) -> DataFrame:
    """Largest properties with a problem status."""
    limit = bounded_limit(limit)
    d = _detail(props).where(problem_status("bygningsstatus"))
    return _top(d, limit, F.col("total_bruksareal").desc(), F.col("address_label").asc(), F.col("id").asc()).drop("id")


def large_risks(props: DataFrame, limit: int = 20) -> DataFrame:
    """Largest properties (area, category, address order)."""
    limit = bounded_limit(limit)
    return _top(
        _detail(props),
        limit,
        F.col("total_bruksareal").desc(),
        F.col("occupancy_category").asc_nulls_last(),
        F.col("address_label").asc(),
        F.col("id").asc(),
    ).drop("id")


# ---------------------------------------------------------------- K18 / K19 heritage


def heritage_summary(props: DataFrame, limit: int = 50, metrics: DataFrame | None = None) -> DataFrame:
    """Flag counts; ``any_flag_count`` is capped at the row limit like the listing."""
    m = metrics if metrics is not None else key_metrics(props)
    return m.select(
        KEY,
        "sefrak_count",
        "kulturminne_count",
        "skjermingsverdig_count",
        F.least(F.col("any_flag_total"), F.lit(limit).cast("bigint")).alias("any_flag_count"),
        "any_flag_total",
    )


def heritage_rows(props: DataFrame, limit: int = 50) -> DataFrame:
    """Largest properties carrying any heritage flag."""
    limit = bounded_limit(limit)
    flags = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("har_sefrakminne", "har_kulturminne", "skjermingsverdig")}
    d = with_key(props).select(
        KEY,
        "id",
        "kommune",
        address_label().alias("address_label"),
        F.col("forenklet_bygningskategori").alias("occupancy_category"),
        area().alias("total_bruksareal"),
        *[v.alias(k) for k, v in flags.items()],
    )
    d = d.where((F.col("har_sefrakminne") == 1) | (F.col("har_kulturminne") == 1) | (F.col("skjermingsverdig") == 1))
    return _top(d, limit, F.col("total_bruksareal").desc(), F.col("address_label").asc(), F.col("id").asc()).drop("id")


# ---------------------------------------------------------------- K20 / K21 tenants


def tenant_summary(props: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Share of properties with sub-units, their area, max sub-units, multi-owner count."""
    m = metrics if metrics is not None else key_metrics(props)
    return m.select(
        KEY,
        "total_properties",
        "with_tenants_count",
        duck_round(
            F.lit(100.0) * F.col("with_tenants_count") / F.greatest(F.col("total_properties"), F.lit(1)), 2
        ).alias("with_tenants_share_percent"),
        duck_round("with_tenants_area", 1).alias("with_tenants_area"),
        "max_underenheter",
        "multi_owner_count",
    )


def tenant_top(props: DataFrame, limit: int = 20) -> DataFrame:
    """Properties with the most sub-units."""
    limit = bounded_limit(limit)
    d = with_key(props).select(
        KEY,
        "id",
        "kommune",
        address_label().alias("address_label"),
        F.col("forenklet_bygningskategori").alias("occupancy_category"),
        F.coalesce(F.col("antall_underenheter"), F.lit(0)).alias("antall_underenheter"),
        area().alias("total_bruksareal"),
        F.coalesce(F.col("antall_eiere"), F.lit(0)).alias("antall_eiere"),
        F.coalesce(F.col("underenheter"), F.lit("")).alias("underenheter"),
    )
    d = d.where(F.col("antall_underenheter") > 0)
    return _top(
        d,
        limit,
        F.col("antall_underenheter").desc(),
        F.col("total_bruksareal").desc(),
        F.col("address_label").asc(),
        F.col("id").asc(),
    ).drop("id")


# ---------------------------------------------------------------- all detail lists (one scan)

# List -> rows per municipality, as the single reports have them by default.
LIST_LIMITS = {"top": 10, "problem": 50, "large": 20, "heritage": 50, "tenants": 20}
HERITAGE_FLAGS = ("har_sefrakminne", "har_kulturminne", "skjermingsverdig")


def detail_lists(props: DataFrame) -> DataFrame:
    """The rows of K07, K16, K17, K19 and K21 in ONE scan: (municipality, list, rank, columns).

    Each row is tagged with the lists it can enter and exploded; the lists share one order, whose
    keys are null where a list does not use them. One ``row_number`` over (municipality, list) cuts
    all of them; its largest limit is applied per task before the shuffle.
    """
    flags = {c: F.coalesce(F.col(c), F.lit(0)) for c in HERITAGE_FLAGS}
    tenants = F.coalesce(F.col("antall_underenheter"), F.lit(0))
    enters = {
        "top": F.lit(True),
        "problem": problem_status("bygningsstatus"),
        "large": F.lit(True),
        "heritage": reduce(or_, [v == 1 for v in flags.values()]),
        "tenants": tenants > 0,
    }
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in enters.items()]))
    d = _detail(props, *[v.alias(k) for k, v in flags.items()], tenants.alias("antall_underenheter"),
                F.coalesce(F.col("antall_eiere"), F.lit(0)).alias("antall_eiere"),
                F.coalesce(F.col("underenheter"), F.lit("")).alias("underenheter"), tags.alias("_tags"))
    d = d.withColumn("list", F.explode("_tags")).drop("_tags")
    d = d.withColumn("underenheter", F.when(F.col("list") == "tenants", F.col("underenheter")))
    order = Window.partitionBy(KEY, "list").orderBy(
        F.when(F.col("list") == "tenants", F.col("antall_underenheter")).desc_nulls_last(),
        F.col("total_bruksareal").desc(),
        F.when(F.col("list") == "large", F.col("occupancy_category")).asc_nulls_last(),
        F.col("address_label").asc(),
        F.col("id").asc(),
    )
    ranked = d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(LIST_LIMITS.values()))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in LIST_LIMITS.items() for x in pair]), F.col("list"))
    return ranked.where(F.col("rank") <= limit).drop("id")


def nested_lists(lists: DataFrame, metrics: DataFrame) -> DataFrame:
    """``detail_lists`` as one row per municipality, with K06's sums of the largest properties: one
    aggregation over bounded rows."""
    status, standard = (F.coalesce(F.col(c), F.lit(MISSING)) for c in ("bygningsstatus", "tek_standard"))
    share = pct("total_bruksareal", "_ka").alias("area_share_percent")
    where = ["kommune", "address_label", "occupancy_category"]
    risk = [*where, "bygningsstatus", "tek_standard", "total_bruksareal"]
    entries = {
        "top_properties_by_area": ("top", [*where, status.alias("bygningsstatus"), standard.alias("tek_standard"), "total_bruksareal", share]),
        "problematic_properties": ("problem", risk),
        "large_risk_schedule": ("large", risk),
        "heritage_rows": ("heritage", [*where, "total_bruksareal", *HERITAGE_FLAGS]),
        "tenant_top_rows": ("tenants", [*where, "antall_underenheter", "total_bruksareal", "antall_eiere", "underenheter"]),
    }

    def listed(name: str, fields: list) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("list") == name, F.struct(F.col("rank"), *fields))))
        return F.when(F.size(rows) > 0, rows)

    def largest(n: int) -> Column:
        return F.sum(F.when((F.col("list") == "top") & (F.col("rank") <= n), F.col("total_bruksareal")))

    rows = lists.join(metrics.select(KEY, F.col("total_bruksareal").alias("_ka")), KEY)
    sums = [largest(n).alias(f"top{n}") for n in (5, 10)]
    out = rows.groupBy(KEY).agg(F.first("_ka").alias("_ka"), *sums, *[listed(n, f).alias(k) for k, (n, f) in entries.items()])
    shares = {f"top{n}_share_percent": F.coalesce(duck_round(pct(f"top{n}", "_ka"), 2), F.lit(0.0)) for n in (5, 10)}
    return out.withColumns({**{f"top{n}_area": duck_round(f"top{n}", 1) for n in (5, 10)}, **shares}).drop("top5", "top10", "_ka")


# ---------------------------------------------------------------- K22 .. K24 data quality


def quality_fields(props: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Completeness of seven fields per municipality, one row per field."""
    m = metrics if metrics is not None else key_metrics(props)
    stack = ", ".join(f"{i}, '{f}', '{label}', {f}" for i, (f, label) in enumerate(QUALITY_FIELDS, start=1))
    long = m.select(
        KEY,
        F.greatest(F.col("total_properties"), F.lit(1)).alias("_den"),
        F.expr(f"stack({len(QUALITY_FIELDS)}, {stack}) AS (field_order, field, label, present_count)"),
    )
    return long.select(
        KEY,
        "field_order",
        "field",
        "label",
        "present_count",
        (F.col("_den") - F.col("present_count")).alias("missing_count"),
        duck_round(F.lit(100.0) * F.col("present_count") / F.col("_den"), 2).alias("completeness_percent"),
    )


def quality_score(props: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Mean of the first five (already rounded) completeness percentages."""
    m = metrics if metrics is not None else key_metrics(props)
    den = F.greatest(F.col("total_properties"), F.lit(1))
    parts = [duck_round(F.lit(100.0) * F.col(f) / den, 2) for f, _ in QUALITY_FIELDS[:SCORE_FIELDS]]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return m.select(KEY, duck_round(total / F.lit(float(SCORE_FIELDS)), 2).alias("score_percent"), "total_properties")


def quality_gaps(fields: DataFrame) -> DataFrame:
    """Fields below 90 % completeness."""
    return fields.where(F.col("completeness_percent") < QUALITY_GAP_BELOW)


# ---------------------------------------------------------------- K27 / K28


def cumulative_share(top: DataFrame) -> DataFrame:
    """Running area share over the top-property list, rounded, capped at 100; a municipality
    without area has share 0 on every row."""
    w = _by_key(F.col("rank").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.select(
        KEY,
        "rank",
        "address_label",
        "total_bruksareal",
        F.least(duck_round(F.sum(F.coalesce("area_share_percent", F.lit(0.0))).over(w), 2), F.lit(100.0)).alias("cumulative_share_percent"),
    )


def portfolio_summary(props: DataFrame) -> DataFrame:
    """Total area per municipality label."""
    return props.groupBy("kommune").agg(F.sum(area()).alias("total_bruksareal"))
