"""Registered scalar-function queries (F01-F30): each projects one function over a fixture.

Array outputs are flattened (joined with '|' plus sizes) for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muniprop import fixtures as fx
from muniprop.functions import dims
from muniprop.functions import scalars as S
from muniprop.queries import register


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fx_raw(spark, sf_dir)


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fx_props(spark, sf_dir)


def _q(name: str, base, cols, key: str = "row_no") -> None:
    """Register ``base(...).select(key, *cols())``; columns are built when the query runs."""
    register(name)(lambda spark, sf_dir: base(spark, sf_dir).select(key, *cols()))


def _joined(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: F.coalesce(x.cast("string"), F.lit("\\N"))), "|")


def short_id_input() -> Column:
    return F.concat_ws("-", "kommunenummer", "gardsnummer", "bruksnummer", "gardsnummer", "bruksnummer")


def type_lookup(df: DataFrame) -> DataFrame:
    """internal id / own code -> resolved NS 3457 code, three names, simplified category."""
    spark = df.sparkSession
    j = df.withColumn("_iid", S.tolerant_int("bygningstype_kode_id")).withColumn("_own", S.tolerant_int("bygningstype_kode_ssb"))
    j = j.join(F.broadcast(dims.building_types(spark)), F.col("_iid") == F.col("bt_internal_id"), "left")
    j = j.withColumn("ns3457", F.coalesce("_own", "bt_ns3457"))
    return j.join(F.broadcast(dims.categories(spark)), F.col("ns3457") == F.col("cat_ns3457"), "left")


_q("f01_kommune_key", _props, lambda: ["kommune", S.kommune_key("kommune").alias("kommune_key")], key="id")
_q("f01b_kommune_label", _raw, lambda: [S.kommune_label("kommune_name").alias("label_name"), S.kommune_label("alle_eiere").alias("label_owner")])
_q("f02_is_selected_key", _props, lambda: [S.selected_key("kommune").alias("selected_key")], key="id")
_q("f03_owner_name", _raw, lambda: [S.name_norm("alle_eiere").alias("owner_norm"), S.name_norm("kommune_name").alias("name_norm")])
_q("f04_split_list", _raw, lambda: [_joined(S.split_list("alle_eiere")).alias("owners"),
    F.size(S.split_list("alle_eiere")).alias("n_owners"),
    _joined(S.split_list("alle_eierandeler")).alias("shares"),
    _joined(S.split_list("alt_adresser")).alias("alt")])
_q("f05_code_ids", _raw, lambda: [_joined(S.code_ids("alle_eierforhold_kode_ids")).alias("codes"), _joined(S.code_ids("tidligste_status_dato")).alias("date_digits")])
_q("f06_percent", _raw, lambda: [S.parse_percent("alle_eierandeler").alias("percent"), S.parse_percent("poststed").alias("percent_place")])
_q("f07_presence", _raw, lambda: [S.present_text("poststed").alias("place_present"),
    S.present_text("alt_adresser").alias("alt_present"),
    S.missing_label("bygningstype_kode_ssb").alias("ssb_missing"),
    S.missing_label("duplikat_gruppe").alias("group_missing")])
_q("f08_postal_text", _raw, lambda: [S.postal_text("postnummer").alias("postal_text")])
_q("f09_postal_int", _raw, lambda: [S.postal_int("postnummer").alias("postal_int"), S.postal_int("poststed").alias("place_int")])
_q("f10_house_number", _raw, lambda: [S.house_number("nummer").alias("house_number"), S.house_number("bruksareal_totalt").alias("area_text")])
_q("f11_address", _raw, lambda: [S.address("adressenavn", "nummer").alias("adresse")])
_q("f12_full_address", _raw, lambda: [S.full_address("adressenavn", "nummer", "postnummer", "poststed").alias("full_address")])
_q("f13_cadastre_key", _raw, lambda: [S.cadastre_key("kommunenummer", "gardsnummer", "bruksnummer").alias("knr_gnr_bnr")])
_q("f14_short_property_id", _raw, lambda: [short_id_input().alias("eiendom"), S.short_property_id(short_id_input()).alias("short_id")])
_q("f15_valid_key", _raw, lambda: [S.valid_key("duplikat_gruppe").alias("group_valid"), S.valid_key("poststed").alias("place_valid")])
_q("f16_tolerant_int", _raw, lambda: [S.tolerant_int("bygningstype_kode_ssb").alias("ssb_int"),
    S.tolerant_int("bygningsstatus_kode_id").alias("status_int"),
    S.tolerant_int("tidligste_status_dato").alias("date_int")])
_q("f20_status_name", _raw, lambda: [S.status_name_expr(S.tolerant_int("bygningsstatus_kode_id")).alias("status_name")])
_q("f21_ownership_type", _raw, lambda: [S.ownership_type_name(F.try_element_at(S.code_ids("alle_eierforhold_kode_ids"), F.lit(2))).alias("ownership_type")])
_q("f23_category_norm", _props, lambda: [S.category_norm("forenklet_bygningskategori").alias("category")], key="id")
_q("f24_tek", _raw, lambda: [S.regulation("tidligste_status_dato")[0].alias("tek_standard"), S.regulation("tidligste_status_dato")[1].alias("tek_ikrafttredelse"), S.regulation("tidligste_status_dato")[2].alias("tek_periode")])
_q("f25_map_url", _raw, lambda: [S.map_url(S.address("adressenavn", "nummer"), "adressenavn", "nummer", "postnummer", "poststed").alias("url"),
    S.map_url(F.lit(None).cast("string"), "adressenavn", "nummer", "postnummer", "poststed").alias("url_parts")])
_q("f26_user_map_url", _raw, lambda: [S.user_map_url("adressenavn", "postnummer", "poststed").alias("url")])
_q("f27_file_segment", _raw, lambda: [S.file_segment(F.regexp_replace("source", "^kartverket:", "")).alias("segment")])
_q("f28_subunit_parse", _raw, lambda: [F.size(S.parse_subunits("underenheter", F.col("adressenavn"))).alias("n_entries"),
    _joined(F.transform(S.parse_subunits("underenheter", F.col("adressenavn")), lambda e: e["name"])).alias("names"),
    _joined(F.transform(S.parse_subunits("underenheter", F.col("adressenavn")), lambda e: e["industry"])).alias("industries"),
    _joined(F.transform(S.parse_subunits("underenheter", F.col("adressenavn")), lambda e: e["code"])).alias("codes"),
    _joined(F.transform(S.parse_subunits("underenheter", F.col("adressenavn")), lambda e: e["address"])).alias("addresses")])
_q("f29_subunit_render", _raw, lambda: [S.render_subunits(S.parse_subunits("underenheter")).alias("rendered")])
_q("f30_age_band", _props, lambda: [S.age_band("tek_standard").alias("age_band")], key="id")


@register("f17_ns3457")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_lookup(_raw(spark, sf_dir)).select("row_no", "ns3457")


@register("f18_type_hierarchy")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = type_lookup(_raw(spark, sf_dir))
    return t.select(
        "row_no",
        F.coalesce("bt_hovedgruppe", F.lit("")).alias("hovedgruppe"),
        F.coalesce("bt_bygningsgruppe", F.lit("")).alias("bygningsgruppe"),
        F.coalesce("bt_bygningstype", F.lit("")).alias("bygningstype"),
    )


@register("f19_type_name")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = type_lookup(_raw(spark, sf_dir))
    return t.select("row_no", S.type_name("bt_hovedgruppe", "bt_bygningsgruppe", "bt_bygningstype").alias("type_name"))


@register("f22_simplified_category")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = type_lookup(_raw(spark, sf_dir))
    return t.select("row_no", F.coalesce("cat_category", F.lit(dims.CATEGORY_FALLBACK)).alias("category"))
