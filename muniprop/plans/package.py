"""Report packages: the underwriting package (K25) and the insights package.

One row per municipality. Scalar sections come from one fused aggregation
(``key_metrics``); list sections are bounded per municipality by their row limits and
nested as rank-ordered ``array<struct>`` columns.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muniprop.functions.scalars import duck_round
from muniprop.operators import reports as R
from muniprop.session import materialize

KEY = R.KEY


class Facts(NamedTuple):
    """All that the packages need of ``properties``, each one scan of it, stored once: one row per
    municipality, one per municipality and value, and the bounded detail lists."""

    metrics: DataFrame
    groups: DataFrame
    lists: DataFrame


def package_facts(props: DataFrame, path: str | None = None) -> Facts:
    """The facts of ``props``; with ``path`` they are kept there for ``read_facts``, so that packages
    of single municipalities need no scan of the whole table."""
    props = R.with_key(props)
    made = Facts(R.key_metrics(props), R.grouped_facts(props), R.detail_lists(props))

    def store(name: str) -> DataFrame:
        if path is None:
            return materialize(getattr(made, name), f"facts-{name}")
        folder = f"{path.rstrip('/')}/{name}"
        getattr(made, name).write.mode("overwrite").parquet(folder)
        return props.sparkSession.read.parquet(folder)

    # Three independent jobs: one fills the cluster where another's last tasks leave it idle.
    with ThreadPoolExecutor(len(Facts._fields)) as jobs:
        return Facts(*jobs.map(store, Facts._fields))


def read_facts(spark: SparkSession, path: str) -> Facts:
    return Facts(*[spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in Facts._fields])


def underwriting_package(props: DataFrame, kommune: str | None = None, facts: Facts | None = None) -> DataFrame:
    """Exposure, occupancy mix, age/standard, status, large risks, heritage, tenants,
    data quality - all sections for every municipality, or for ``kommune`` alone.

    ``properties`` is read for ``facts`` only, in three scans; facts that were kept are passed in.
    """
    props = R.with_key(props)
    m, facts, lists = facts or package_facts(props)
    if kommune is not None:
        lists = R.for_kommune(lists, kommune)
    mix = R.occupancy_mix(props, 30, facts)
    status = R.status_distribution(props, facts=facts)
    fields = R.quality_fields(props, m)

    sections = [
        R.selected_totals(props, m),
        R.nested_lists(lists, m),
        R._nest(
            R.by_kommune(props, facts=facts),
            "by_kommune",
            ["kommune", "property_count", "total_bruksareal", "property_share_percent", "area_share_percent", "is_selected"],
        ),
        R.heritage_summary(props, 50, m),
        R.tenant_summary(props, m).drop("total_properties"),
        R.quality_score(props, m),
        R._nest(mix, "by_category", ["occupancy_category", "building_count", "total_bruksareal", "count_share_percent", "area_share_percent"]),
        R._nest(
            R.top_by_count(mix).drop("rank").withColumnRenamed("count_rank", "rank"),
            "top_categories_by_count",
            ["occupancy_category", "building_count", "total_bruksareal"],
        ),
        R._nest(R.tek_distribution(props, facts=facts), "tek_distribution", ["tek_standard", "property_count", "total_bruksareal", "property_share_percent", "area_share_percent"]),
        R._nest(
            R.age_bands(props, facts).withColumnRenamed("band_order", "rank"),
            "age_band_distribution",
            ["age_band", "property_count", "total_bruksareal", "area_share_percent"],
        ),
        R._nest(status, "status_distribution", ["bygningsstatus", "property_count", "total_bruksareal", "property_share_percent", "area_share_percent"]),
        R._nest(R.problem_statuses(status), "problematic_statuses", ["bygningsstatus"]),
        R._nest(fields.withColumnRenamed("field_order", "rank"), "quality_fields", ["field", "label", "present_count", "missing_count", "completeness_percent"]),
        R._nest(R.quality_gaps(fields).withColumnRenamed("field_order", "rank"), "quality_gaps", ["field", "label", "completeness_percent"]),
        R._nest(R.top_by_area(mix), "top_categories_by_area", ["occupancy_category", "building_count", "total_bruksareal"]),
    ]
    if kommune is not None:
        sections = [R.for_kommune(s, kommune) for s in sections]
    return R.merge_on_key(sections)


def _size(c: str):
    return F.coalesce(F.size(F.col(c)), F.lit(0))


def flatten_package(pkg: DataFrame) -> DataFrame:
    """Scalar view of K25 for comparisons: scalars plus list sizes and leading entries."""
    lists = [
        "by_kommune",
        "top_properties_by_area",
        "by_category",
        "top_categories_by_count",
        "tek_distribution",
        "age_band_distribution",
        "status_distribution",
        "problematic_statuses",
        "problematic_properties",
        "large_risk_schedule",
        "heritage_rows",
        "tenant_top_rows",
    ]
    return pkg.select(
        KEY,
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
        "sefrak_count",
        "kulturminne_count",
        "skjermingsverdig_count",
        "any_flag_count",
        "with_tenants_count",
        "with_tenants_share_percent",
        "with_tenants_area",
        "max_underenheter",
        "multi_owner_count",
        "score_percent",
        F.size(F.filter("quality_fields", lambda f: f["completeness_percent"] < R.QUALITY_GAP_BELOW)).alias("quality_gap_count"),
        *[_size(c).alias(f"n_{c}") for c in lists],
        F.col("top_properties_by_area")[0]["address_label"].alias("largest_property_address"),
        F.col("by_category")[0]["occupancy_category"].alias("largest_category"),
        F.col("top_categories_by_count")[0]["occupancy_category"].alias("most_common_category"),
        F.col("large_risk_schedule")[0]["address_label"].alias("largest_risk_address"),
    )


def insights_distribution(props: DataFrame, limit: int = 30, facts: DataFrame | None = None) -> DataFrame:
    """K26 distribution: K01 rows with the share recomputed over the returned rows only."""
    d = R.occupancy_distribution(props, limit, facts)
    tot = F.sum("total_bruksareal").over(Window.partitionBy(KEY))
    return d.withColumn(
        "share_percent",
        F.when(tot <= 0, F.lit(0.0)).otherwise(duck_round(F.lit(100.0) * F.col("total_bruksareal") / tot, 2)),
    )


def insights_package(props: DataFrame, limit: int = 30) -> DataFrame:
    """Distribution (recomputed share) + largest category + K25, per municipality."""
    props = R.with_key(props)
    facts = package_facts(props)
    dist = R._nest(insights_distribution(props, limit, facts.groups), "occupancy_distribution", ["occupancy_category", "building_count", "total_bruksareal", "share_percent"])
    largest = R.largest_occupancy(props, facts.groups).select(
        KEY,
        F.struct("occupancy_category", "total_bruksareal", "building_count").alias("largest_occupancy"),
    )
    return R.merge_on_key([dist, largest, underwriting_package(props, facts=facts)])
