"""DuckDB oracle SQL for the scalar-function queries."""

from __future__ import annotations

from muniprop.fixtures import FX_PROPS_SQL, FX_RAW_SQL, duck_fixture
from muniprop.functions import dims
from muniprop.oracle_sql import frag as f

RAW = f"WITH raw AS ({duck_fixture(FX_RAW_SQL)})\n"
PROPS = f"WITH props AS ({duck_fixture(FX_PROPS_SQL)})\n"


def raw(select: str) -> str:
    return RAW + f"SELECT row_no, {select} FROM raw"


def props(select: str) -> str:
    return PROPS + f"SELECT id, {select} FROM props"


def joined(lst: str) -> str:
    return f"array_to_string(list_transform({lst}, lambda x: COALESCE(CAST(x AS VARCHAR), '\\N')), '|')"


def kommune_label(x: str) -> str:
    c = f.collapse(x)
    return f"(CASE WHEN {c} IS NULL OR {c} = '' THEN 'Ukjent Kommune' WHEN ends_with(lower({c}), ' kommune') THEN {c} ELSE {c} || ' Kommune' END)"


def selected_key(x: str) -> str:
    return f"regexp_replace(lower({f.collapse(f'COALESCE(CAST({x} AS VARCHAR), {chr(39)}{chr(39)})')}), ' kommune$', '')"


def status_name(x: str) -> str:
    branches = " ".join(f"WHEN {x} = {k} THEN '{v}'" for k, v in sorted(dims.BUILDING_STATUS.items()))
    return f"(CASE WHEN {x} IS NULL THEN '' {branches} ELSE '' END)"


def ownership_type(x: str) -> str:
    branches = " ".join(f"WHEN {x} = {k} THEN '{v}'" for k, v in sorted(dims.OWNERSHIP_TYPES.items()))
    return f"(CASE WHEN {x} IS NULL THEN '' {branches} ELSE 'Unknown (' || CAST({x} AS VARCHAR) || ')' END)"


def short_id(x: str) -> str:
    parts = f"string_split({x}, '-')"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN len({parts}) >= 3 THEN array_to_string({parts}[1:3], '-') ELSE {x} END)"


SHORT_IN = "concat_ws('-', kommunenummer, gardsnummer, bruksnummer, gardsnummer, bruksnummer)"

u = f.trim_ws("underenheter")
PARTS = (
    f"(CASE WHEN underenheter IS NULL OR {u} IN ('', '-') OR lower({u}) IN ('nan', '<na>') THEN []::VARCHAR[] "
    f"ELSE list_filter(list_transform(string_split(underenheter, ';'), lambda x: {f.trim_ws('x')}), lambda x: x <> '') END)"
)


def sub_field(i: int, default: str) -> str:
    hit = f"regexp_matches(p, '{f.SUBUNIT}')"
    return f"CASE WHEN {hit} THEN {f.trim_ws(f'regexp_extract(p, {chr(39)}{f.SUBUNIT}{chr(39)}, {i})')} ELSE {default} END"


def rendered() -> str:
    name, ind, code = sub_field(1, "p"), sub_field(2, "''"), sub_field(3, "''")
    return (
        f"array_to_string(list_transform({PARTS}, lambda p: CASE WHEN ({ind}) <> '' AND ({code}) <> '' "
        f"THEN ({name}) || ' [' || ({ind}) || ', ' || ({code}) || ']' ELSE ({name}) END), '; ')"
    )


TYPES = (
    RAW
    + f""", t AS (
  SELECT raw.*, bt.*, c.cat_category, COALESCE({f.tolerant_int('bygningstype_kode_ssb')}, bt.bt_ns3457) AS ns3457
  FROM raw
  LEFT JOIN {dims.building_types_sql().replace(' AS t(', ' AS bt(')} ON {f.tolerant_int('bygningstype_kode_id')} = bt.bt_internal_id
  LEFT JOIN {dims.categories_sql().replace(' AS t(', ' AS c(')} ON COALESCE({f.tolerant_int('bygningstype_kode_ssb')}, bt.bt_ns3457) = c.cat_ns3457
)
"""
)

SQL = {
    "f01_kommune_key": props("kommune, lower(trim(replace(replace(kommune, ' Kommune', ''), ' kommune', ''))) AS kommune_key"),
    "f01b_kommune_label": raw(f"{kommune_label('kommune_name')} AS label_name, {kommune_label('alle_eiere')} AS label_owner"),
    "f02_is_selected_key": props(f"{selected_key('kommune')} AS selected_key"),
    "f03_owner_name": raw(f"{f.name_norm('alle_eiere')} AS owner_norm, {f.name_norm('kommune_name')} AS name_norm"),
    "f04_split_list": raw(
        f"{joined(f.split_list('alle_eiere'))} AS owners, CAST(len({f.split_list('alle_eiere')}) AS INTEGER) AS n_owners, "
        f"{joined(f.split_list('alle_eierandeler'))} AS shares, {joined(f.split_list('alt_adresser'))} AS alt"
    ),
    "f05_code_ids": raw(
        f"COALESCE({joined(f.code_ids('alle_eierforhold_kode_ids'))}, '') AS codes, "
        f"COALESCE({joined(f.code_ids('tidligste_status_dato'))}, '') AS date_digits"
    ),
    "f06_percent": raw(f"{f.parse_percent('alle_eierandeler')} AS percent, {f.parse_percent('poststed')} AS percent_place"),
    "f07_presence": raw(
        f"{f.present('poststed')} AS place_present, {f.present('alt_adresser')} AS alt_present, "
        f"{f.missing_label('bygningstype_kode_ssb')} AS ssb_missing, {f.missing_label('duplikat_gruppe')} AS group_missing"
    ),
    "f08_postal_text": raw(f"{f.postal_text('postnummer')} AS postal_text"),
    "f09_postal_int": raw(f"{f.postal_int('postnummer')} AS postal_int, {f.postal_int('poststed')} AS place_int"),
    "f10_house_number": raw(f"{f.house_number('nummer')} AS house_number, {f.house_number('bruksareal_totalt')} AS area_text"),
    "f11_address": raw(f"{f.address('adressenavn', 'nummer')} AS adresse"),
    "f12_full_address": raw(f"{f.full_address('adressenavn', 'nummer', 'postnummer', 'poststed')} AS full_address"),
    "f13_cadastre_key": raw(f"{f.cadastre_key('kommunenummer', 'gardsnummer', 'bruksnummer')} AS knr_gnr_bnr"),
    "f14_short_property_id": raw(f"{SHORT_IN} AS eiendom, {short_id(SHORT_IN)} AS short_id"),
    "f15_valid_key": raw(
        "(duplikat_gruppe IS NOT NULL AND " + f.trim_ws("duplikat_gruppe") + " NOT IN ('', '-')) AS group_valid, "
        "(poststed IS NOT NULL AND " + f.trim_ws("poststed") + " NOT IN ('', '-')) AS place_valid"
    ),
    "f16_tolerant_int": raw(
        f"{f.tolerant_int('bygningstype_kode_ssb')} AS ssb_int, {f.tolerant_int('bygningsstatus_kode_id')} AS status_int, "
        f"{f.tolerant_int('tidligste_status_dato')} AS date_int"
    ),
    "f20_status_name": raw(f"{status_name(f.tolerant_int('bygningsstatus_kode_id'))} AS status_name"),
    "f21_ownership_type": raw(f"{ownership_type(f.code_ids('alle_eierforhold_kode_ids') + '[2]')} AS ownership_type"),
    "f23_category_norm": props(f"{f.category_norm('forenklet_bygningskategori')} AS category"),
    "f24_tek": raw(
        ", ".join(
            f"{f.regulation('tidligste_status_dato', i)} AS {c}"
            for i, c in enumerate(("tek_standard", "tek_ikrafttredelse", "tek_periode"))
        )
    ),
    "f25_map_url": raw(
        f"{f.map_url(f.address('adressenavn', 'nummer'), 'adressenavn', 'nummer', 'postnummer', 'poststed')} AS url, "
        f"{f.map_url('CAST(NULL AS VARCHAR)', 'adressenavn', 'nummer', 'postnummer', 'poststed')} AS url_parts"
    ),
    "f26_user_map_url": raw(f"{f.maps_url([f.norm_str('adressenavn'), f.postal_int('postnummer'), f.norm_str('poststed')])} AS url"),
    "f27_file_segment": raw(
        "split_part(regexp_replace(regexp_replace(source, '^kartverket:', ''), '\\.[^.]*$', ''), '_', 1) AS segment"
    ),
    "f28_subunit_parse": raw(
        f"CAST(len({PARTS}) AS INTEGER) AS n_entries, "
        f"{joined(f'list_transform({PARTS}, lambda p: {sub_field(1, chr(112))})')} AS names, "
        f"{joined(f'list_transform({PARTS}, lambda p: {sub_field(2, chr(39) * 2)})')} AS industries, "
        f"{joined(f'list_transform({PARTS}, lambda p: {sub_field(3, chr(39) * 2)})')} AS codes, "
        f"{joined(f'list_transform({PARTS}, lambda p: adressenavn)')} AS addresses"
    ),
    "f29_subunit_render": raw(f"{rendered()} AS rendered"),
    "f30_age_band": props(
        "CASE WHEN tek_standard IN ('TEK17', 'TEK10') THEN '2010+' WHEN tek_standard IN ('TEK07', 'TEK97') THEN '1997-2009' "
        "WHEN tek_standard LIKE 'BF%' THEN 'Pre-1997' ELSE 'Unknown' END AS age_band"
    ),
    "f17_ns3457": TYPES + "SELECT row_no, ns3457 FROM t",
    "f18_type_hierarchy": TYPES
    + "SELECT row_no, COALESCE(bt_hovedgruppe, '') AS hovedgruppe, COALESCE(bt_bygningsgruppe, '') AS bygningsgruppe, "
    "COALESCE(bt_bygningstype, '') AS bygningstype FROM t",
    "f19_type_name": TYPES
    + "SELECT row_no, COALESCE(NULLIF(bt_bygningstype, ''), NULLIF(bt_bygningsgruppe, ''), COALESCE(bt_hovedgruppe, '')) AS type_name FROM t",
    "f22_simplified_category": TYPES + f"SELECT row_no, COALESCE(cat_category, '{dims.CATEGORY_FALLBACK}') AS category FROM t",
}
