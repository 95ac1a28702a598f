"""Registered queries: one per operator id, each ``(spark, sf_dir) -> DataFrame``.

Nested outputs (K08, K25, K26) are flattened to scalar columns so they can be compared
with the DuckDB oracles; the library functions themselves return the nested form.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muniprop import fixtures as fx
from muniprop.operators import reports as R
from muniprop.plans import package as P
from muniprop.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_key(fx.fx_props(spark, sf_dir))


def _report(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(props(spark, sf_dir))


_report("k01_occupancy_distribution", lambda p: R.occupancy_distribution(p, 30))
_report("k02_largest_occupancy", R.largest_occupancy)
_report("k03_portfolio_totals", R.portfolio_totals)
_report("k04_selected_totals", R.selected_totals)
_report("k05_by_kommune", R.by_kommune)
_report("k06_concentration", R.concentration)
_report("k07_top_properties", lambda p: R.top_properties(p, 10))
_report("k09_occupancy_mix", lambda p: R.occupancy_mix(p, 30))
_report("k10_top_by_area", lambda p: R.top_by_area(R.occupancy_mix(p, 30)))
_report("k11_top_by_count", lambda p: R.top_by_count(R.occupancy_mix(p, 30)))
_report("k12_tek_distribution", R.tek_distribution)
_report("k13_age_bands", R.age_bands)
_report("k14_status_distribution", R.status_distribution)
_report("k15_problem_statuses", lambda p: R.problem_statuses(R.status_distribution(p)))
_report("k16_problem_properties", lambda p: R.problem_properties(p, 50))
_report("k17_large_risks", lambda p: R.large_risks(p, 20))
_report("k18_heritage_summary", R.heritage_summary)
_report("k19_heritage_rows", lambda p: R.heritage_rows(p, 50))
_report("k20_tenant_summary", R.tenant_summary)
_report("k21_tenant_top", lambda p: R.tenant_top(p, 20))
_report("k22_quality_fields", R.quality_fields)
_report("k23_quality_score", R.quality_score)
_report("k24_quality_gaps", lambda p: R.quality_gaps(R.quality_fields(p)))
_report("k27_cumulative_share", lambda p: R.cumulative_share(R.top_properties(p, 10)))
_report("k28_portfolio_summary", R.portfolio_summary)


@register("k08_exposure_dashboard")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.exposure_dashboard(props(spark, sf_dir))
    return d.select(
        R.KEY,
        "selected_properties",
        "selected_bruksareal",
        "property_share_percent",
        "area_share_percent",
        "portfolio_total_properties",
        "portfolio_total_bruksareal",
        "top5_area",
        "top5_share_percent",
        "top10_area",
        "top10_share_percent",
        F.coalesce(F.size("by_kommune"), F.lit(0)).alias("n_by_kommune"),
        F.coalesce(F.size("top_properties_by_area"), F.lit(0)).alias("n_top_properties"),
        F.col("top_properties_by_area")[0]["address_label"].alias("largest_property_address"),
        F.array_join(F.transform("by_kommune", lambda x: x["kommune"]), "|").alias("labels"),
    )


@register("k25_underwriting_package")
def k25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flatten_package(P.underwriting_package(props(spark, sf_dir)))


# Lists of the package whose whole contents the oracle compares, with the fields in order.
K25_LISTS = {
    "problematic_properties": ("kommune", "address_label", "occupancy_category", "bygningsstatus", "tek_standard", "total_bruksareal"),
    "large_risk_schedule": ("kommune", "address_label", "occupancy_category", "bygningsstatus", "tek_standard", "total_bruksareal"),
    "heritage_rows": ("kommune", "address_label", "occupancy_category", "total_bruksareal", "har_sefrakminne", "har_kulturminne", "skjermingsverdig"),
    "tenant_top_rows": ("kommune", "address_label", "occupancy_category", "antall_underenheter", "total_bruksareal", "antall_eiere", "underenheter"),
    "quality_fields": ("field", "label", "present_count", "missing_count"),
    "quality_gaps": ("field", "label"),
    "top_categories_by_area": ("occupancy_category", "building_count", "total_bruksareal"),
    "by_category": ("occupancy_category", "building_count", "total_bruksareal"),
    "status_distribution": ("bygningsstatus", "property_count", "total_bruksareal"),
    "tek_distribution": ("tek_standard", "property_count", "total_bruksareal"),
}


@register("k25_lists")
def k25_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the package's lists as a row (municipality, list, rank, content)."""
    pkg = materialize(P.underwriting_package(props(spark, sf_dir)), "k25-lists")

    def text(entry, f):
        return entry[f].cast("bigint").cast("string") if f == "total_bruksareal" else entry[f].cast("string")

    parts = []
    for name, fields in K25_LISTS.items():
        rows = pkg.select(R.KEY, F.explode(name).alias("e"))
        content = F.concat_ws("|", *[text(F.col("e"), f) for f in fields])
        parts.append(rows.select(R.KEY, F.lit(name).alias("list"), F.col("e.rank").cast("bigint").alias("rank"), content.alias("content")))
    return reduce(DataFrame.unionByName, parts)


@register("k26_insights_package")
def k26(spark: SparkSession, sf_dir: str) -> DataFrame:
    pkg = P.insights_package(props(spark, sf_dir))
    rows = pkg.select(R.KEY, F.inline("occupancy_distribution"), "largest_occupancy")
    return rows.select(
        R.KEY,
        "rank",
        "occupancy_category",
        "building_count",
        "total_bruksareal",
        "share_percent",
        F.col("largest_occupancy.occupancy_category").alias("largest_category"),
        F.col("largest_occupancy.total_bruksareal").alias("largest_bruksareal"),
        F.col("largest_occupancy.building_count").alias("largest_building_count"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k25(spark, sf_dir)


# Pipeline, scalar, source and SQL-API queries live in their own modules.
from muniprop import queries_pipeline as _qp  # noqa: E402,F401
from muniprop import queries_scalars as _qs  # noqa: E402,F401
from muniprop import queries_sources as _qsrc  # noqa: E402,F401
