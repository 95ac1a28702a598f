"""DuckDB oracle SQL for the source queries (S01-S14, P11) and the bounded-SQL queries (Q)."""

from __future__ import annotations

from muniprop.fixtures import FX_RAW_SQL, duck_fixture
from muniprop.oracle_sql import frag as f
from muniprop.oracle_sql import pipeline as pl
from muniprop.plans import sqlapi
from muniprop.queries_sources import (
    EXTRA_FILES,
    FILE_DIR,
    GATE_PROBES,
    INC_CHANGED,
    INC_EXTRA_SQL,
    INC_FIELDS,
    INC_NEW,
    INC_SECOND_SQL,
    Q01_SQL,
    Q06_SQL,
    Q08_SQL,
    Q_LIMIT,
    S01_EXTRA_SQL,
    S01_FIELDS,
    header_line,
    sheet_line,
)
from muniprop.sources import hashing as H
from muniprop.sources import sheet_columns as SC

RAW = f"WITH raw AS ({duck_fixture(FX_RAW_SQL)})"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FILES = (
    RAW
    + f""",
files AS (
  SELECT '{FILE_DIR}' || name AS path FROM (
    SELECT DISTINCT regexp_replace(source, '^kartverket:', '') AS name FROM raw
    UNION ALL SELECT * FROM (VALUES {', '.join(f'({_lit(n)})' for n in EXTRA_FILES)}) v(name)
  )
),
fx AS (
  SELECT path, regexp_extract(path, '([^/]*)$', 1) AS file_name,
    regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM files
),
parts AS (SELECT *, string_split(stem, '_') AS p FROM fx),
core AS (
  SELECT *, CASE WHEN len(p) >= 2 AND lower(p[-1]) = 'imputed' AND lower(p[-2]) = 'properties' THEN p[1:len(p) - 2]
                 WHEN lower(p[-1]) = 'properties' THEN p[1:len(p) - 1] ELSE p END AS c
  FROM parts
),
named AS (SELECT *, CASE WHEN len(c) > 1 THEN array_to_string(c[2:], '_') ELSE '' END AS name_part FROM core),
listed AS (
  SELECT * FROM named
  WHERE (ends_with(file_name, '_Properties.xlsx') OR ends_with(file_name, '_Properties_Imputed.xlsx'))
    AND NOT starts_with(file_name, '~$')
)"""
)

STRICT = "(?i)^\\d{4}_(.+?)_Properties(_Imputed)?$"
STRICT_NAME = (
    f"CASE WHEN regexp_matches(stem, '{STRICT}') THEN trim(replace(split_part(regexp_extract(stem, '{STRICT}', 1), '___', 1), '_', ' ')) "
    "ELSE trim(replace(stem, '_', ' ')) END"
)

CANDS = (
    "CASE WHEN len(p) < 2 THEN [" + f.name_norm("stem") + "] ELSE "
    + f.ordered_distinct(
        "list_filter(list_transform(list_filter(string_split(name_part, '___'), lambda x: x <> ''), lambda x: "
        + f.name_norm("x")
        + ") || [" + f.name_norm("name_part") + ", " + f.name_norm("split_part(name_part, '_', 1)") + "], lambda x: x <> '')"
    )
    + " END"
)

AVAILABLE = """avail AS (
  SELECT lower(label) AS key, arg_min(label, path) AS label FROM (
    SELECT path, """ + f.collapse(
    "replace(split_part(CASE WHEN len(p) >= 2 THEN CASE WHEN len(c) > 1 THEN array_to_string(c[2:], '_') ELSE p[2] END ELSE stem END, '___', 1), '_', ' ')"
) + """ AS label FROM listed
  ) WHERE label <> '' GROUP BY 1
)"""


def _digest(table: str, cols: list[str]) -> str:
    parts = []
    for c in sorted(cols):
        name, kind = c.split(":")
        v = f"CAST({name} AS VARCHAR)"
        parts.append(f"'{c}:' || COALESCE(length({v}) || ':' || {v}, '-') || ';'")
    return f"sha256({' || '.join(parts)})"


def gate(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, {_lit(sqlapi.QUOTED)}, 'q', 'g'), {_lit(sqlapi.COMMENTS)}, ' ', 'g')"
    step = (
        "lambda a, x: {'d': greatest(a.d + CASE x.t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END, 0), "
        "'t': CASE WHEN x.t = ')' THEN a.t || ' ' WHEN x.t = '(' OR a.d > 0 THEN a.t ELSE a.t || x.t END}"
    )
    pieces = f"list_transform(regexp_extract_all(bare, {_lit(sqlapi.PIECES)}), lambda p: {{'d': 0, 't': p}})"
    outside = f"CASE WHEN first = 'with' THEN list_reduce(list_prepend({{'d': 0, 't': ''}}, {pieces}), {step}) END"
    reads = ", ".join(_lit(w) for w in sorted(sqlapi.READ_PREFIXES))
    return (
        f"SELECT doc_id, CASE WHEN first IN ({reads}) AND NOT (first = 'with' AND (regexp_matches(outside.t, {_lit(sqlapi.OPENS_WRITE)}) "
        f"OR outside.d > 0)) THEN 'read' ELSE 'write' END AS verdict FROM (SELECT doc_id, first, {outside} AS outside FROM ("
        f"SELECT doc_id, bare, lower(regexp_extract(bare, {_lit(sqlapi.FIRST_WORD)}, 1)) AS first FROM (SELECT doc_id, {bare} AS bare FROM "
    )


def s01_value(name: str) -> str:
    raw = f"({S01_EXTRA_SQL[name]})" if name in S01_EXTRA_SQL else name
    if name in SC.NUMBERS:
        return f"CAST({raw} AS DOUBLE)"
    if name in SC.INTEGERS:
        return f"CAST(CAST({raw} AS DOUBLE) AS BIGINT)"
    text = f"CAST({raw} AS VARCHAR)"
    # an empty cell of a CSV sheet reads as null
    return f"NULLIF({text}, '')" if name != "underenheter" else f"CASE WHEN kommunenummer % 2 = 1 THEN NULLIF({text}, '') END"


SQL = {
    "s01_scan": RAW + "\nSELECT source, replace(kommune_name, '_', ' ') AS kommune_name, "
    + ", ".join(f"{s01_value(c)} AS {c}" for c in S01_FIELDS) + " FROM raw",
    "s02_manifest": FILES
    + f"""
SELECT path, file_name, regexp_extract(file_name, '^(\\d{{4}})_', 1) AS kommunenummer, {STRICT_NAME} AS kommune_name,
  CASE WHEN ends_with(lower(stem), '_properties_imputed') THEN 'imputed' ELSE 'raw' END AS variant
FROM fx WHERE NOT starts_with(file_name, '~$') AND contains(file_name, '_Properties')""",
    "s03_candidates": FILES + f"\nSELECT path, array_to_string({CANDS}, '|') AS candidates FROM named",
    "s04_resolve": FILES
    + f""",
cand AS (SELECT path, unnest({CANDS}) AS cand FROM listed),
targets AS (
  SELECT DISTINCT target FROM (
    SELECT kommune_name AS target FROM raw
    UNION ALL SELECT * FROM (VALUES ('Heroy'), ('nordland'), ('Sor Fron'), ('Nowhere')) v(target)
  )
)
SELECT t.target, min(c.path) AS path, COUNT(c.path) > 1 AS ambiguous
FROM targets t LEFT JOIN cand c ON {f.name_norm('t.target')} = c.cand
WHERE {f.name_norm('t.target')} <> '' GROUP BY t.target""",
    "s05_variant": FILES
    + "\nSELECT path, 'imputed' AS variant FROM fx WHERE NOT starts_with(file_name, '~$') AND contains(file_name, '_Properties') "
    "AND ends_with(lower(stem), '_properties_imputed')",
    "s06_municipalities": FILES + ",\n" + AVAILABLE + "\nSELECT key, label FROM avail",
    "s07_resolve_label": FILES
    + ",\n"
    + AVAILABLE
    + f""",
props AS ({duck_fixture(__import__('muniprop.fixtures', fromlist=['FX_PROPS_SQL']).FX_PROPS_SQL)}),
vals AS (SELECT DISTINCT value FROM (SELECT kommune AS value FROM props UNION ALL SELECT replace(kommune_name, '_', ' ') FROM raw))
SELECT value, COALESCE(a.label, trim(value)) AS label FROM vals LEFT JOIN avail a ON lower(trim(value)) = a.key""",
    "s08_properties": pl.BASE
    + ",\n"
    + pl.KEPT
    + ",\n"
    + pl.enrich("kept", "d04")
    + ",\ninc AS (SELECT * FROM d04 WHERE "
    + pl.STATUS_INC
    + "),\n"
    + pl.merge("inc", "d05")
    + f""",
lab AS (SELECT *, regexp_replace(regexp_replace(source, '^kartverket:', ''), '\\.[^.]*$', '') AS _stem FROM d05),
lab2 AS (SELECT *, {pl.kommune_label(pl.LABEL)} AS kommune FROM lab)
SELECT row_no, source, kommune, lower(trim(replace(replace(kommune, ' Kommune', ''), ' kommune', ''))) AS kommune_key, adresse FROM lab2""",
    "s09_row_id": pl.BASE
    + ",\n"
    + pl.KEPT
    + ",\n"
    + pl.enrich("kept", "d04")
    + ",\ninc AS (SELECT * FROM d04 WHERE "
    + pl.STATUS_INC
    + "),\n"
    + pl.merge("inc", "d05")
    + "\nSELECT CAST(row_number() OVER (ORDER BY source, row_no) - 1 AS BIGINT) AS id, source, row_no FROM d05",
    "s10_load_report": pl.BASE
    + ",\n"
    + pl.KEPT
    + ",\n"
    + pl.enrich("kept", "d04")
    + ",\ninc AS (SELECT * FROM d04 WHERE "
    + pl.STATUS_INC
    + "),\n"
    + pl.merge("inc", "d05")
    + """,
per AS (
  SELECT s.source, COALESCE(a.rows_loaded, 0) AS rows_loaded, COALESCE(b.before, 0) - COALESCE(a.rows_loaded, 0) AS duplicates_removed,
    COALESCE(a.alt_address_backfilled, 0) AS alt_address_backfilled
  FROM (SELECT DISTINCT source FROM raw UNION ALL SELECT 'kartverket:9999_EMPTY_Properties.xlsx') s
  LEFT JOIN (SELECT source, COUNT(*) AS rows_loaded, COUNT(*) FILTER (WHERE alt_adresser_fra_knr_gnr_bnr) AS alt_address_backfilled FROM d05 GROUP BY 1) a USING (source)
  LEFT JOIN (SELECT source, COUNT(*) AS before FROM inc GROUP BY 1) b USING (source)
)
SELECT source, SUM(rows_loaded)::BIGINT AS rows_loaded, SUM(duplicates_removed)::BIGINT AS duplicates_removed,
  SUM(alt_address_backfilled)::BIGINT AS alt_address_backfilled
FROM per GROUP BY ROLLUP (source)""",
    "s11_content_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, COUNT(*) AS copies FROM documents GROUP BY 1",
    "s14_json_safe": RAW
    + """
SELECT row_no,
  CASE WHEN bruksareal_totalt IS NULL OR isnan(bruksareal_totalt) OR isinf(bruksareal_totalt) THEN NULL
       WHEN bruksareal_totalt = floor(bruksareal_totalt) THEN CAST(CAST(bruksareal_totalt AS BIGINT) AS VARCHAR)
       ELSE CAST(bruksareal_totalt AS VARCHAR) END AS bruksareal_json,
  CASE WHEN nummer IS NULL OR isnan(nummer) OR isinf(nummer) THEN NULL
       WHEN nummer = floor(nummer) THEN CAST(CAST(nummer AS BIGINT) AS VARCHAR)
       ELSE CAST(nummer AS VARCHAR) END AS nummer_json
FROM raw""",
    "p11_rename": RAW
    + "\nSELECT row_no, kommunenummer AS Kommunenummer, gardsnummer AS Gardsnummer, bruksnummer AS Bruksnummer, "
    "adressenavn AS Adressenavn, nummer AS Nummer, postnummer AS Postnummer, poststed AS Poststed FROM raw",
    "q01_bounded_query": "SELECT c_custkey, orders, CAST(key_sum AS BIGINT) AS key_sum, LEAST(n, 25)::BIGINT AS row_count, n > 25 AS truncated "
    "FROM (SELECT *, COUNT(*) OVER () AS n, row_number() OVER (ORDER BY c_custkey) AS k FROM ("
    + Q01_SQL.replace("?", "2").replace(" ORDER BY c_custkey", "")
    + f")) WHERE k <= {Q_LIMIT}",
    "q02_read_gate": gate("statement")
    + "(SELECT * FROM (VALUES "
    + ", ".join(f"({-(i + 1)}, {_lit(s)})" for i, s in enumerate(GATE_PROBES))
    + ") v(doc_id, statement) UNION ALL SELECT doc_id, text FROM documents))))",
    "q05_preview": "SELECT * FROM supplier LIMIT 2000",
    "q06_published_query": Q06_SQL,
    "q07_published_table": "SELECT * FROM nation LIMIT 2000",
    "q08_read_published": Q08_SQL,
}

SQL["s13_materialise"] = pl.SQL["d07_statistics"]


def inc_value(name: str) -> str:
    """A column of the sheets of the per-source build, as it is read back."""
    value = f"({INC_EXTRA_SQL[name]})" if name in INC_EXTRA_SQL else name
    if name in SC.INTEGERS:
        return f"CAST(CAST({value} AS DOUBLE) AS BIGINT)"
    return value


# The sheets as the second build finds them: rows numbered by their place, and the hash of each file.
INC = f"""WITH raw0 AS (SELECT * FROM ({duck_fixture(FX_RAW_SQL)}) WHERE {INC_SECOND_SQL}),
raw AS (
  SELECT row_number() OVER (PARTITION BY source ORDER BY row_no) - 1 AS row_no, source, replace(kommune_name, '_', ' ') AS kommune_name,
    {', '.join(f'{inc_value(c)} AS {c}' for c in INC_FIELDS)}
  FROM raw0
),
hashes AS (
  SELECT source, sha256({_lit(header_line(INC_FIELDS))} || chr(10) || string_agg({sheet_line(INC_FIELDS, INC_EXTRA_SQL)}, chr(10) ORDER BY row_no) || chr(10)) AS sha256
  FROM raw0 GROUP BY source
),
{pl.OWN}"""
SQL["s13_incremental_build"] = (
    INC + ",\n" + pl.KEPT + ",\n" + pl.enrich("kept", "d04") + ",\ninc AS (SELECT * FROM d04 WHERE " + pl.STATUS_INC + "),\n" + pl.merge("inc", "d05")
    + f""",
lab AS (SELECT *, regexp_replace(regexp_replace(source, '^kartverket:', ''), '\\.[^.]*$', '') AS _stem FROM d05)
SELECT row_number() OVER (ORDER BY source, row_no) - 1 AS id, source, row_no, CASE WHEN kommunenummer IN ({INC_CHANGED}, {INC_NEW}) THEN 2 ELSE 1 END AS build,
  {pl.kommune_label(pl.LABEL)} AS kommune, adresse, alt_adresser, knr_gnr_bnr, tek_standard, forenklet_bygningskategori, underenheter, antall_underenheter
FROM lab"""
)
SQL["d07_statistics_with_hash"] = INC + ",\n" + pl._STATS + """
SELECT source, sha256 AS file_hash, total_rows, deduplicated_rows, unfiltered_rows, unfiltered_deduplicated_rows,
  unfiltered_rows - included_rows AS filtered_out_rows, excluded_status_rows AS filtered_out_status_rows,
  excluded_status_rows, excluded_status_deduplicated_rows
FROM stats JOIN hashes USING (source)"""
SQL["s11_file_dedup"] = INC + """
SELECT source, sha256, regexp_replace(source, '^kartverket:', '') AS stored_as, true AS is_stored FROM hashes
UNION ALL SELECT 'kartverket:9001_TWIN_Properties.xlsx', sha256, regexp_replace(source, '^kartverket:', ''), false FROM hashes
WHERE starts_with(source, 'kartverket:1001_')"""


def _buckets(rows: str, cols: list[str]) -> str:
    lanes = ", ".join(f"SUM(('0x' || substr(h, {1 + i * H.LANE_HEX}, {H.LANE_HEX}))::HUGEINT) AS s{i}" for i in range(H.LANES))
    text = " || ':' || ".join(["CAST(n AS VARCHAR)"] + [f"CAST(s{i} % {H.LANE_MOD} AS VARCHAR)" for i in range(H.LANES)])
    return (
        f"SELECT k, bucket, n, sha256({text}) AS digest FROM (SELECT k, substr(h, 1, 2) AS bucket, COUNT(*) AS n, {lanes} "
        f"FROM (SELECT {{k}} AS k, {_digest('', cols)} AS h FROM {rows}) GROUP BY ALL)"
    )


def _bucketed(table: str, cols: list[str]) -> str:
    return (
        f"SELECT '{table}' AS table_name, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS row_count, "
        f"sha256(string_agg(bucket || ':' || digest, ';' ORDER BY bucket)) AS fingerprint FROM ({_buckets(table, cols).replace('{k}', '1')})"
    )


CUSTOMER = ["c_custkey:bigint", "c_name:string", "c_nationkey:int", "c_acctbal:double", "c_mktsegment:string"]
SQL["s12_fingerprint"] = "\nUNION ALL\n".join(
    [
        _bucketed("region", ["r_regionkey:int", "r_name:string"]),
        _bucketed("nation", ["n_nationkey:int", "n_name:string", "n_regionkey:int"]),
        _bucketed("customer", CUSTOMER),
    ]
)
_PART = [c for c in CUSTOMER if not c.startswith("c_nationkey")]
_MOVED = "(SELECT * REPLACE (CASE WHEN c_custkey % 97 = 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal) FROM customer)"
SQL["s12_changed_buckets"] = (
    f"WITH a AS ({_buckets('customer', _PART).replace('{k}', 'c_nationkey')}), b AS ({_buckets(_MOVED, _PART).replace('{k}', 'c_nationkey')})\n"
    "SELECT DISTINCT COALESCE(a.k, b.k) AS c_nationkey, COALESCE(a.bucket, b.bucket) AS bucket FROM a FULL JOIN b ON a.k = b.k AND a.bucket = b.bucket "
    "WHERE a.digest IS DISTINCT FROM b.digest"
)
