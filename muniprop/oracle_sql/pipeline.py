"""DuckDB oracle SQL for the pipeline operators (P03-P05, D01-D08) over the fx-raw fixture."""

from __future__ import annotations

from muniprop.fixtures import FX_RAW_SQL, duck_fixture
from muniprop.functions import dims
from muniprop.oracle_sql import frag as f

INCLUDED = ", ".join(f"{float(i)}" for i in dims.INCLUDED_STATUS_IDS)
STATUS_INC = f"COALESCE({f.tolerant_double('bygningsstatus_kode_id')} IN ({INCLUDED}), false)"
DUP = "contains(lower(COALESCE(duplikat_flagg, '')), 'duplicate')"

_k = f.name_norm("kommune_name")
OWN = f"""own AS (
  SELECT *, {f.split_list('alle_eiere')} AS _o, {f.split_list('alle_eierforhold_kode_ids')} AS _c,
    {f.split_list('alle_eierandeler')} AS _s,
    CASE WHEN ends_with({_k}, ' kommune') THEN {_k} ELSE {_k} || ' kommune' END AS _kk
  FROM raw
),
own2 AS (SELECT *, list_transform(_o, lambda x: {f.name_norm('x')} = _kk) AS _mine FROM own),
own3 AS (
  SELECT *, kommune_name IS NOT NULL AND kommune_name <> ''
    AND len(_o) > 0 AND len(_c) > 0 AND len(_s) > 0 AND len(_o) = len(_c) AND len(_o) = len(_s)
    AND COALESCE(list_bool_or(_mine), false)
    AND COALESCE(list_bool_or(list_transform(_mine, lambda m, i: m AND list_contains({f.code_ids('_c[i]')}, 0))), false)
    AND COALESCE(list_sum(list_transform(_mine, lambda m, i: CASE WHEN m THEN COALESCE({f.parse_percent('_s[i]')}, 0.0) ELSE 0.0 END)), 0.0) >= 100.0 - 1e-6
    AND COALESCE(list_bool_and(list_transform(_s, lambda x: {f.parse_percent('x')} IS NOT NULL)), true)
    AND NOT (COALESCE(list_bool_or(list_transform(_mine, lambda m: NOT m)), false)
             AND COALESCE(list_sum(list_transform(_s, lambda x: COALESCE({f.parse_percent('x')}, 0.0))), 0.0) > 100.0 + 1e-6)
    AS _kept
  FROM own2
)"""

BASE = f"WITH raw AS ({duck_fixture(FX_RAW_SQL)}),\n{OWN}"

RAW_COLS = (
    "row_no, source, kommune_name, kommunenummer, gardsnummer, bruksnummer, bygningstype_kode_id, bygningstype_kode_ssb, "
    "bygningsstatus_kode_id, tidligste_status_dato, bruksareal_totalt, adressenavn, nummer, postnummer, poststed, "
    "alt_adresser, alle_eiere, alle_eierforhold_kode_ids, alle_eierandeler, underenheter, antall_underenheter, "
    "duplikat_flagg, duplikat_gruppe"
)


def backfill(src: str, name: str) -> str:
    """D01 over the rows of CTE ``src`` as CTE ``name``."""
    key = f.cadastre_key("kommunenummer", "gardsnummer", "bruksnummer")
    addr = f.full_address("adressenavn", "nummer", "postnummer", "poststed")
    existing = (
        f"(CASE WHEN {f.present('alt_adresser')} THEN list_filter(list_transform(string_split(alt_adresser, ';'), "
        f"lambda s: {f.trim_ws('s')}), lambda s: s <> '') ELSE []::VARCHAR[] END)"
    )
    return f"""{name}_a AS (SELECT *, {key} AS _key, COALESCE({addr}, '') AS _addr FROM {src}),
{name}_lk AS (
  SELECT source, _key, list(_ad ORDER BY _first) AS _found FROM (
    SELECT source, _key, {f.trim_ws('_addr')} AS _ad, min(row_no) AS _first FROM {name}_a
    WHERE {f.present('_key')} AND {f.trim_ws('_addr')} <> '' GROUP BY ALL
  ) GROUP BY ALL
),
{name} AS (
  SELECT * EXCLUDE (alt_adresser, _found, _key, _addr, _hit),
    CASE WHEN _hit THEN array_to_string({f.ordered_distinct(f'({existing} || _found)')}, ';') ELSE alt_adresser END AS alt_adresser,
    _hit AS alt_adresser_fra_knr_gnr_bnr
  FROM (
    SELECT a.*, lk._found,
      {f.present('a._key')} AND {f.trim_ws('a._addr')} = '' AND COALESCE(len(lk._found), 0) > 0 AS _hit
    FROM {name}_a a LEFT JOIN {name}_lk lk ON a.source = lk.source AND a._key = lk._key
  )
)"""


def enrich(src: str, name: str) -> str:
    """D02 over CTE ``src`` (backfill, key, address, link, regulation, categories) as ``name``."""
    tek = ", ".join(f"{f.regulation('tidligste_status_dato', i)} AS {c}" for i, c in enumerate(("tek_standard", "tek_ikrafttredelse", "tek_periode")))
    return backfill(src, f"{name}_b") + f""",
{name}_c AS (
  SELECT *, {f.cadastre_key('kommunenummer', 'gardsnummer', 'bruksnummer')} AS knr_gnr_bnr,
    {f.address('adressenavn', 'nummer')} AS adresse FROM {name}_b
),
{name}_d AS (
  SELECT *, {f.map_url('adresse', 'adressenavn', 'nummer', 'postnummer', 'poststed')} AS google_maps_link, {tek},
    {f.tolerant_int('bygningstype_kode_id')} AS _iid, {f.tolerant_int('bygningstype_kode_ssb')} AS _own
  FROM {name}_c
),
{name} AS (
  SELECT * EXCLUDE (bygningstype_kode_ssb, _iid, _own, bt_internal_id, bt_ns3457, bt_hovedgruppe, bt_bygningsgruppe,
                    bt_bygningstype, cat_ns3457, cat_category),
    CASE WHEN _own IS NULL THEN CAST(COALESCE(_own, bt_ns3457) AS VARCHAR) ELSE bygningstype_kode_ssb END AS bygningstype_kode_ssb,
    COALESCE(bt_hovedgruppe, '') AS hovedgruppe, COALESCE(bt_bygningsgruppe, '') AS bygningsgruppe,
    COALESCE(bt_bygningstype, '') AS bygningstype,
    {f.category_norm(f"COALESCE(cat_category, '{dims.CATEGORY_FALLBACK}')")} AS forenklet_bygningskategori
  FROM {name}_d
  LEFT JOIN {dims.building_types_sql().replace(' AS t(', ' AS bt(')} ON _iid = bt_internal_id
  LEFT JOIN {dims.categories_sql().replace(' AS t(', ' AS c(')} ON COALESCE(_own, bt_ns3457) = cat_ns3457
)"""


def merge(src: str, name: str) -> str:
    """D05 over CTE ``src`` as ``name``."""
    g = f.trim_ws("duplikat_gruppe")
    grp = f"(CASE WHEN duplikat_gruppe IS NULL OR {g} = '' OR lower({g}) = 'nan' THEN NULL ELSE {g} END)"
    a = f.trim_ws("adresse")
    addr = f"(CASE WHEN adresse IS NULL OR {a} = '' OR lower({a}) IN ('nan', '<na>') THEN NULL ELSE {a} END)"
    u = f.trim_ws("underenheter")
    parts = (
        f"(CASE WHEN underenheter IS NULL OR {u} IN ('', '-') OR lower({u}) IN ('nan', '<na>') THEN []::VARCHAR[] "
        f"ELSE list_filter(list_transform(string_split(underenheter, ';'), lambda x: {f.trim_ws('x')}), lambda x: x <> '') END)"
    )
    hit = f"regexp_matches(_part, '{f.SUBUNIT}')"

    def grp_(i: int, default: str) -> str:
        return f"CASE WHEN {hit} THEN {f.trim_ws(f'regexp_extract(_part, {chr(39)}{f.SUBUNIT}{chr(39)}, {i})')} ELSE {default} END"

    return f"""{name}_g AS (SELECT *, {grp} AS _g, {addr} AS _addr, {parts} AS _parts FROM {src}),
{name}_e AS (
  SELECT source, _g, row_no, unnest(_parts) AS _part, generate_subscripts(_parts, 1) AS _pos FROM {name}_g WHERE _g IS NOT NULL
),
{name}_f AS (
  SELECT *, {grp_(1, '_part')} AS _name, {grp_(2, "''")} AS _ind, {grp_(3, "''")} AS _code FROM {name}_e
  QUALIFY row_number() OVER (PARTITION BY source, _g, {grp_(1, '_part')} ORDER BY row_no, _pos) = 1
),
{name}_l AS (
  SELECT source, _g, COUNT(*) AS _n,
    string_agg(CASE WHEN _ind <> '' AND _code <> '' THEN _name || ' [' || _ind || ', ' || _code || ']' ELSE _name END, '; '
               ORDER BY row_no, _pos) AS _rendered
  FROM {name}_f GROUP BY ALL
),
{name} AS (
  SELECT x.* EXCLUDE (underenheter, antall_underenheter, _g, _addr, _parts),
    CASE WHEN COALESCE(l._n, 0) > 0 THEN l._rendered ELSE x.underenheter END AS underenheter,
    CAST(CASE WHEN COALESCE(l._n, 0) > 0 THEN l._n ELSE x.antall_underenheter END AS INTEGER) AS antall_underenheter,
    CAST(CASE WHEN COALESCE(l._n, 0) > 0 THEN l._n END AS INTEGER) AS n_parsed
  FROM {name}_g x LEFT JOIN {name}_l l ON x.source = l.source AND x._g = l._g
  WHERE NOT {DUP.replace('duplikat_flagg', 'x.duplikat_flagg')}
)"""


KEPT = f"kept AS (SELECT {RAW_COLS} FROM own3 WHERE _kept)"
ENRICHED_COLS = (
    "row_no, alt_adresser, alt_adresser_fra_knr_gnr_bnr, knr_gnr_bnr, adresse, google_maps_link, tek_standard, "
    "tek_ikrafttredelse, tek_periode, bygningstype_kode_ssb, hovedgruppe, bygningsgruppe, bygningstype, forenklet_bygningskategori"
)
CATEGORY_COLS = "row_no, bygningstype_kode_ssb, hovedgruppe, bygningsgruppe, bygningstype, forenklet_bygningskategori"

LABEL = (
    "CASE WHEN regexp_matches(_stem, '(?i)^\\d{4}_(.+?)_Properties(_Imputed)?$') "
    "THEN replace(split_part(regexp_extract(_stem, '(?i)^\\d{4}_(.+?)_Properties(_Imputed)?$', 1), '___', 1), '_', ' ') "
    "ELSE replace(_stem, '_', ' ') END"
)


def kommune_label(x: str) -> str:
    c = f.collapse(x)
    return f"(CASE WHEN {c} IS NULL OR {c} = '' THEN 'Ukjent Kommune' WHEN ends_with(lower({c}), ' kommune') THEN {c} ELSE {c} || ' Kommune' END)"


SQL = {
    "p03_ownership_filter": BASE + "\nSELECT row_no, source, kommune_name, alle_eiere FROM own3 WHERE _kept",
    "p04_status_split": BASE + f"\nSELECT row_no, {STATUS_INC} AS status_included FROM own3 WHERE _kept",
    "p05_drop_duplicates": BASE + f"\nSELECT row_no, duplikat_flagg FROM raw WHERE NOT {DUP}",
    "d01_alt_address_backfill": BASE + ",\n" + KEPT + ",\n" + backfill("kept", "d01")
    + "\nSELECT row_no, alt_adresser, alt_adresser_fra_knr_gnr_bnr FROM d01",
    "d02_enrich": BASE + ",\n" + enrich("raw", "d02") + f"\nSELECT {ENRICHED_COLS} FROM d02",
    "d03_building_category": BASE + ",\n" + enrich("raw", "d02") + f"\nSELECT {CATEGORY_COLS} FROM d02",
    "d04_filtered_path": BASE + ",\n" + KEPT + ",\n" + enrich("kept", "d04") + f"\nSELECT {ENRICHED_COLS} FROM d04",
    "d05_subunit_merge": BASE + ",\n" + KEPT + ",\n" + enrich("kept", "d04") + ",\ninc AS (SELECT * FROM d04 WHERE "
    + STATUS_INC + "),\n" + merge("inc", "d05") + "\nSELECT row_no, underenheter, antall_underenheter, n_parsed FROM d05",
    "d08_enriched_kommune": BASE + ",\n" + KEPT + ",\n" + enrich("kept", "d04") + f""",
lab AS (SELECT *, regexp_replace(regexp_replace(source, '^kartverket:', ''), '\\.[^.]*$', '') AS _stem FROM d04 WHERE {STATUS_INC})
SELECT row_no, source, {kommune_label(LABEL)} AS kommune, knr_gnr_bnr, adresse, tek_standard, forenklet_bygningskategori FROM lab""",
}

_STATS = f"""stats AS (
  SELECT source,
    COUNT(*) FILTER (WHERE _kept) AS total_rows,
    COUNT(*) FILTER (WHERE _kept AND {STATUS_INC}) AS included_rows,
    COUNT(*) FILTER (WHERE _kept AND {STATUS_INC} AND NOT {DUP}) AS deduplicated_rows,
    COUNT(*) AS unfiltered_rows,
    COUNT(*) FILTER (WHERE NOT {DUP}) AS unfiltered_deduplicated_rows,
    COUNT(*) FILTER (WHERE _kept AND NOT {STATUS_INC}) AS excluded_status_rows,
    COUNT(*) FILTER (WHERE _kept AND NOT {STATUS_INC} AND NOT {DUP}) AS excluded_status_deduplicated_rows
  FROM own3 GROUP BY 1
)"""

SQL["d07_statistics"] = BASE + ",\n" + _STATS + """
SELECT source, total_rows, deduplicated_rows, unfiltered_rows, unfiltered_deduplicated_rows,
  unfiltered_rows - included_rows AS filtered_out_rows, excluded_status_rows AS filtered_out_status_rows,
  excluded_status_rows, excluded_status_deduplicated_rows
FROM stats"""

SQL["d06_bundle_counts"] = BASE + ",\n" + _STATS + """
SELECT source, frame, rows FROM (
  SELECT source, 'data' AS frame, included_rows AS rows FROM stats
  UNION ALL SELECT source, 'data_dedup', deduplicated_rows FROM stats
  UNION ALL SELECT source, 'unfiltered', unfiltered_rows FROM stats
  UNION ALL SELECT source, 'unfiltered_dedup', unfiltered_deduplicated_rows FROM stats
  UNION ALL SELECT source, 'excluded_status', excluded_status_rows FROM stats
  UNION ALL SELECT source, 'excluded_status_dedup', excluded_status_deduplicated_rows FROM stats
) WHERE rows > 0"""
