"""Registered pipeline queries (P03-P05, D01-D08) over the fx-raw fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muniprop import fixtures as fx
from muniprop.operators.enrich import backfill_alt_addresses, drop_duplicates_by_flag, split_status, status_included
from muniprop.operators.ownership import ownership_filter
from muniprop.plans import pipeline as PL
from muniprop.queries import register
from muniprop.session import materialize
from muniprop.sources.manifest import source_label

ENRICHED = [
    "row_no", "alt_adresser", "alt_adresser_fra_knr_gnr_bnr", "knr_gnr_bnr", "adresse", "google_maps_link",
    "tek_standard", "tek_ikrafttredelse", "tek_periode", "bygningstype_kode_ssb", "hovedgruppe", "bygningsgruppe",
    "bygningstype", "forenklet_bygningskategori",
]
CATEGORY = ["row_no", "bygningstype_kode_ssb", "hovedgruppe", "bygningsgruppe", "bygningstype", "forenklet_bygningskategori"]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fx_raw(spark, sf_dir)


@register("p03_ownership_filter")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership_filter(raw(spark, sf_dir)).select("row_no", "source", "kommune_name", "alle_eiere")


@register("p04_status_split")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership_filter(raw(spark, sf_dir)).select("row_no", status_included().alias("status_included"))


@register("p05_drop_duplicates")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_duplicates_by_flag(raw(spark, sf_dir)).select("row_no", "duplikat_flagg")


@register("d01_alt_address_backfill")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill_alt_addresses(materialize(ownership_filter(raw(spark, sf_dir)))).select(
        "row_no", "alt_adresser", "alt_adresser_fra_knr_gnr_bnr"
    )


@register("d02_enrich")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.enrich(raw(spark, sf_dir)).select(*ENRICHED)


@register("d03_building_category")
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.enrich(raw(spark, sf_dir)).select(*CATEGORY)


@register("d04_filtered_path")
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.filtered_path(raw(spark, sf_dir)).select(*ENRICHED)


@register("d05_subunit_merge")
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.properties_rows(raw(spark, sf_dir)).select(
        "row_no", "underenheter", "antall_underenheter", F.size("parsed_underenheter").alias("n_parsed")
    )


@register("d06_bundle_counts")
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = PL.build_bundle(raw(spark, sf_dir))
    counts = [
        getattr(b, name).groupBy("source").agg(F.count(F.lit(1)).alias("rows")).withColumn("frame", F.lit(name))
        for name in b._fields
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.select("source", "frame", "rows")


@register("d07_statistics")
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.statistics(raw(spark, sf_dir))


def enriched_kommune(raw_rows: DataFrame, variant: str = "raw") -> DataFrame:
    """The enriched, status-included rows of every municipality, labelled by source file.

    (The one-municipality call is ``.where(kommune_key == key)`` on this frame.)
    """
    from muniprop.sources.manifest import variant as variant_of

    r = raw_rows.where(variant_of(F.regexp_replace("source", "^kartverket:", "")) == variant)
    included, _ = split_status(PL.filtered_path(r))
    return included.withColumn("kommune", source_label(F.col("source")))


@register("d08_enriched_kommune")
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_kommune(raw(spark, sf_dir)).select(
        "row_no", "source", "kommune", "knr_gnr_bnr", "adresse", "tek_standard", "forenklet_bygningskategori"
    )
