"""Enrichment operators: status split, duplicate drop, address backfill, categories.

Grouped work is keyed by ``(source, key)``: each source file is its own universe, exactly
as when files were processed one at a time, and the key spreads the work across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muniprop.functions import dims
from muniprop.functions.scalars import (
    address_text,
    cadastre_key,
    category_norm,
    full_address_text,
    house_text,
    map_url,
    missing_label,
    postal_text,
    present_text,
    regulation_date,
    regulation_index,
    regulation_texts,
    tolerant_double,
    tolerant_int,
    trim_ws,
)

# ---------------------------------------------------------------- P04 / P05


def status_included(c: Column | str = "bygningsstatus_kode_id") -> Column:
    """P04 predicate: numeric status id in the included set; null/unparsable -> excluded."""
    v = tolerant_double(c)
    return F.coalesce(v.isin(*[float(i) for i in dims.INCLUDED_STATUS_IDS]), F.lit(False))


def included(df: DataFrame) -> Column:
    """P04 for the rows of ``df``: without a status column every row is included, also where only
    the row's own sheet lacks it (``status_absent``)."""
    if "bygningsstatus_kode_id" not in df.columns:
        return F.lit(True)
    inc = status_included()
    return inc | F.coalesce("status_absent", F.lit(False)) if "status_absent" in df.columns else inc


def split_status(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(included, excluded)."""
    inc = included(df)
    return df.where(inc), df.where(~inc)


def is_duplicate(c: Column | str = "duplikat_flagg") -> Column:
    """P05 predicate: the flag mentions 'duplicate' (any case); null is not a duplicate."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(F.coalesce(col, F.lit(""))).contains("duplicate")


def has_duplicates(df: DataFrame) -> bool:
    return {"duplikat_flagg", "duplikat_gruppe"} <= set(df.columns)


def duplicates(df: DataFrame) -> Column:
    """P05 for the rows of ``df``: flags count where the row's sheet has flag and group."""
    if not has_duplicates(df):
        return F.lit(False)
    return is_duplicate() & ~F.coalesce("duplicates_absent", F.lit(False)) if "duplicates_absent" in df.columns else is_duplicate()


def drop_duplicates_by_flag(df: DataFrame) -> DataFrame:
    """P05."""
    if "duplikat_flagg" not in df.columns:
        return df
    return df.where(~is_duplicate())


# ---------------------------------------------------------------- D01 alternate addresses


FLAG = "alt_adresser_fra_knr_gnr_bnr"
ALT_KEY = "alt_key"  # of rows stored apart from the lists: the key whose known addresses a row gets
BLANKS = 4096  # join keys of rows that look nothing up


def can_backfill(df: DataFrame) -> bool:
    return "adressenavn" in df.columns and "nummer" in df.columns


def _lookup_key(df: DataFrame) -> Column:
    if "knr_gnr_bnr" in df.columns:
        return trim_ws(F.coalesce(F.col("knr_gnr_bnr").cast("string"), F.lit("")))
    return cadastre_key("kommunenummer", "gardsnummer", "bruksnummer")


def known_addresses(df: DataFrame) -> DataFrame:
    """(source, _key, found, found_text): the distinct addresses of each cadastre key in row order,
    from the few columns that make them, and as one text.

    A row has an address where it has a name. Distinct (source, key, address) first: the partial
    aggregation collapses a hot key to its distinct addresses per task before anything is shuffled.
    """
    # The parts are columns of their own, so that each is made once per row.
    named = df.where(present_text("adressenavn")).select(
        "source", "row_no", _lookup_key(df).alias("_key"), trim_ws("adressenavn").alias("_name"), trim_ws(F.col("nummer").cast("string")).alias("_no"),
        postal_text("postnummer").alias("_post"), F.when(present_text("poststed"), trim_ws("poststed")).alias("_town"),
    )
    named = named.where(present_text("_key")).withColumn("_no", house_text(F.col("_no")))
    a = named.select("source", "row_no", "_key", full_address_text(F.col("_name"), F.col("_no"), F.col("_post"), F.col("_town")).alias("_a"))
    first = a.groupBy("source", "_key", "_a").agg(F.min("row_no").alias("_first"))
    ordered = F.sort_array(F.collect_list(F.struct("_first", "_a")))
    lists = first.groupBy("source", "_key").agg(F.transform(ordered, lambda s: s["_a"]).alias("found"))
    return lists.withColumn("found_text", F.array_join("found", ";"))


def _blank() -> Column:
    return F.concat(F.lit("\u0000"), F.pmod(F.coalesce("row_no", F.lit(0)), F.lit(BLANKS)).cast("string"))


def look_up_addresses(df: DataFrame, known: DataFrame) -> DataFrame:
    """``df`` with the columns of ``known`` beside (source, _key) for a row's key if the row has a valid
    key and no address of its own, else nulls.

    One left join, so wide rows are read once. Rows that look nothing up get one of ``BLANKS`` keys
    that no cadastre key equals: they spread over the tasks instead of meeting under one null.
    """
    key = _lookup_key(df)
    needs = present_text(key) & ~present_text("adressenavn")
    return df.withColumn("_key", F.when(needs, key).otherwise(_blank())).join(known, ["source", "_key"], "left").drop("_key")


def with_found(df: DataFrame) -> Column:
    """alt_adresser: the row's own alternate addresses and those of the column ``found``, first
    occurrences in order. Rows without own ones, nearly all, take the text made once per key."""
    alt = F.col("alt_adresser") if "alt_adresser" in df.columns else F.lit(None).cast("string")
    existing = F.filter(F.transform(F.split(alt, ";"), lambda x: trim_ws(x)), lambda x: x != "")
    every = F.array_join(F.array_distinct(F.concat(existing, F.col("found"))), ";")
    return F.when(F.col("found_text").isNull(), alt).when(present_text(alt), every).otherwise(F.col("found_text"))


def mark_addresses(df: DataFrame, known: DataFrame) -> DataFrame:
    """D01 without its lists: the flag, and ``ALT_KEY`` of the rows that get known addresses. Every row
    of a key would carry the same list, which grows with the rows of the key; rows that are stored
    keep the key, the lists are stored once (``known``), and ``render_addresses`` brings both together."""
    if "alt_adresser" not in df.columns:
        df = df.withColumn("alt_adresser", F.lit(None).cast("string"))
    looked = look_up_addresses(df, known.select("source", "_key", F.col("_key").alias(ALT_KEY)))
    return looked.select(*df.columns, F.col(ALT_KEY).isNotNull().alias(FLAG), ALT_KEY)


def render_addresses(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``mark_addresses`` with their whole ``alt_adresser``, without ``ALT_KEY``."""
    looked = df.withColumn("_key", F.coalesce(ALT_KEY, _blank())).join(
        known.select("source", "_key", "found", "found_text"), ["source", "_key"], "left"
    )
    return looked.withColumn("alt_adresser", with_found(looked)).select(*[c for c in df.columns if c != ALT_KEY])


def backfill_alt_addresses(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """For rows with a valid cadastre key and no address, append the distinct addresses of the
    other rows with the same key (same source), in row order; flag those rows. Addresses come from
    ``known`` (all rows that count), by default from ``df``."""
    if not can_backfill(df):
        return df.withColumn(FLAG, F.lit(False))
    looked = look_up_addresses(df, known_addresses(df if known is None else known))
    return looked.withColumns({FLAG: F.col("found_text").isNotNull(), "alt_adresser": with_found(looked)}).select(
        *df.columns, *([] if "alt_adresser" in df.columns else ["alt_adresser"]), FLAG
    )


# ---------------------------------------------------------------- D02 building blocks


def add_cadastre_key(df: DataFrame) -> DataFrame:
    """F13 as a column."""
    return df.withColumn("knr_gnr_bnr", cadastre_key("kommunenummer", "gardsnummer", "bruksnummer"))


def add_address(df: DataFrame) -> DataFrame:
    """F11 as a column (only when both parts exist)."""
    if "adressenavn" not in df.columns or "nummer" not in df.columns:
        return df
    # Both steps of the house number are columns: each is looked at several times.
    staged = df.withColumn("_no", trim_ws(F.col("nummer").cast("string"))).withColumn("_no", house_text(F.col("_no")))
    return staged.withColumn("adresse", address_text(F.col("adressenavn"), F.col("_no"))).drop("_no")


def add_map_link(df: DataFrame) -> DataFrame:
    """F25 as a column."""
    def c(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return df.withColumn(
        "google_maps_link",
        map_url(c("adresse"), c("adressenavn"), F.col("nummer") if "nummer" in df.columns else F.lit(None).cast("double"),
                c("postnummer"), c("poststed")),
    )


def add_regulation(df: DataFrame) -> DataFrame:
    """F24 as three columns."""
    if "tidligste_status_dato" not in df.columns:
        return df
    staged = df.withColumn("_tek_d", regulation_date("tidligste_status_dato"))
    staged = staged.withColumn("_tek_i", regulation_index("_tek_d"))
    std, in_force, period = regulation_texts("_tek_i")
    return staged.withColumns({"tek_standard": std, "tek_ikrafttredelse": in_force, "tek_periode": period}).drop(
        "_tek_d", "_tek_i"
    )


HIERARCHY = (("hovedgruppe", "bt_hovedgruppe"), ("bygningsgruppe", "bt_bygningsgruppe"), ("bygningstype", "bt_bygningstype"))


def add_building_category(df: DataFrame) -> DataFrame:
    """Resolve the NS 3457 code, patch missing hierarchy names, simplified category.

    Both lookups are broadcast joins against fixed code tables (128 and 127 rows).
    """
    cols = df.columns
    if "bygningstype_kode_ssb" not in cols and "bygningstype_kode_id" not in cols:
        return df
    spark = df.sparkSession
    ssb_raw = F.col("bygningstype_kode_ssb") if "bygningstype_kode_ssb" in cols else F.lit(None).cast("string")
    internal = tolerant_int(F.col("bygningstype_kode_id")) if "bygningstype_kode_id" in cols else F.lit(None).cast("int")
    j = df.withColumn("_iid", internal).withColumn("_own", tolerant_int(ssb_raw))
    j = j.join(F.broadcast(dims.building_types(spark)), F.col("_iid") == F.col("bt_internal_id"), "left")
    j = j.withColumn("_ns", F.coalesce(F.col("_own"), F.col("bt_ns3457")))
    j = j.join(F.broadcast(dims.categories(spark)), F.col("_ns") == F.col("cat_ns3457"), "left")

    out: dict[str, Column] = {}
    if "bygningstype_kode_ssb" in cols:
        out["bygningstype_kode_ssb"] = F.when(F.col("_own").isNull(), F.col("_ns").cast("string")).otherwise(ssb_raw)
    else:
        out["bygningstype_kode_ssb"] = F.col("_ns").cast("string")
    for name, dim_col in HIERARCHY:
        derived = F.coalesce(F.col(dim_col), F.lit(""))
        out[name] = F.when(missing_label(name), derived).otherwise(F.col(name)) if name in cols else derived
    simplified = F.coalesce(F.col("cat_category"), F.lit(dims.CATEGORY_FALLBACK))
    cat = "forenklet_bygningskategori"
    current = F.when(missing_label(cat), simplified).otherwise(F.col(cat)) if cat in cols else simplified
    out[cat] = category_norm(current)
    keep = [c for c in cols if c not in out]
    return j.select(*keep, *[v.alias(k) for k, v in out.items()])
