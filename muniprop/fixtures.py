"""Test inputs derived from the driver's read-only tables (see FIXTURES.md).

The same SQL text runs in Spark (tables passed as DataFrame arguments) and in DuckDB
(inlined as a CTE in the oracle SQL), so both engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_FROM = "FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"

FX_RAW_SQL = """SELECT
  o_orderkey AS row_no,
  CONCAT('kartverket:', CAST(1000 + n_nationkey AS VARCHAR(10)), '_', n_name, '_Properties.xlsx') AS source,
  n_name AS kommune_name,
  1000 + n_nationkey AS kommunenummer,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS INT) END AS gardsnummer,
  CAST(o_custkey % 7 AS INT) AS bruksnummer,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 131 AS INT) END AS bygningstype_kode_id,
  CASE o_orderkey % 9 WHEN 0 THEN '613' WHEN 1 THEN '721.0' WHEN 2 THEN '193' WHEN 3 THEN '330'
       WHEN 4 THEN 'x' WHEN 5 THEN '' ELSE NULL END AS bygningstype_kode_ssb,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 19 AS VARCHAR(10)) END AS bygningsstatus_kode_id,
  CASE WHEN o_orderkey % 29 = 0 THEN 'bad-date' WHEN o_orderkey % 17 = 0 THEN NULL
       WHEN o_orderkey % 31 = 0 THEN '2010-07-01' WHEN o_orderkey % 37 = 0 THEN '2010-06-30'
       ELSE CONCAT(CAST(1935 + o_orderkey % 89 AS VARCHAR(10)), '-06-15T00:00:00') END AS tidligste_status_dato,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey * 7919 % 5000 AS DOUBLE) END AS bruksareal_totalt,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CONCAT('Gate ', CAST(o_custkey % 90 AS VARCHAR(10))) END AS adressenavn,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END AS nummer,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN '0150' ELSE CAST(4000 + o_custkey % 900 AS VARCHAR(10)) END AS postnummer,
  CASE WHEN o_orderkey % 8 = 0 THEN '-' ELSE CONCAT('STED ', CAST(n_nationkey AS VARCHAR(10))) END AS poststed,
  CASE WHEN o_orderkey % 14 = 0 THEN 'Gammel vei 1;Gammel vei 2' ELSE NULL END AS alt_adresser,
  CASE WHEN o_orderkey % 16 = 15 THEN NULL WHEN o_orderkey % 16 = 9 THEN 'Privat AS'
       WHEN o_orderkey % 16 IN (6, 8, 12, 13, 14) THEN CONCAT(n_name, ' KOMMUNE; Privat AS')
       WHEN o_orderkey % 16 = 7 THEN CONCAT(n_name, ' KOMMUNE;', n_name, ' kommune')
       ELSE CONCAT(n_name, '  Kommune') END AS alle_eiere,
  CASE WHEN o_orderkey % 16 IN (6, 7, 8, 12, 13) THEN '0; 11' WHEN o_orderkey % 16 = 10 THEN '1' ELSE '0' END AS alle_eierforhold_kode_ids,
  CASE o_orderkey % 16 WHEN 6 THEN '50.0%; 50.0%' WHEN 7 THEN '50.0%;50.0%' WHEN 8 THEN '100.0%; 100.0%'
       WHEN 12 THEN '100.0%; 0.0%' WHEN 13 THEN '100.0%; -' WHEN 14 THEN '100.0%' ELSE '100.0%' END AS alle_eierandeler,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CONCAT('Skole ', CAST(o_orderkey % 50 AS VARCHAR(10)), ' [Utdanning, grunnskole, 85.201]; Kantine')
       WHEN o_orderkey % 5 = 2 THEN '-' ELSE CONCAT('Lager ', CAST(o_orderkey % 50 AS VARCHAR(10)), ' [Lagring, 52.1]') END AS underenheter,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 2 WHEN o_orderkey % 5 = 2 THEN 0 ELSE 1 END AS antall_underenheter,
  CASE o_orderkey % 4 WHEN 0 THEN 'Unique' WHEN 1 THEN 'Primary' WHEN 2 THEN 'Duplicate of primary' ELSE 'Extension' END AS duplikat_flagg,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CONCAT('G', CAST(n_nationkey AS VARCHAR(10)), '-', CAST(o_custkey % 60 AS VARCHAR(10))) END AS duplikat_gruppe
""" + _FROM

FX_PROPS_SQL = """SELECT
  o_orderkey AS id,
  CASE WHEN o_orderkey % 100 = 3 THEN REPLACE(n_name, '_', ' ') ELSE CONCAT(REPLACE(n_name, '_', ' '), ' Kommune') END AS kommune,
  CONCAT('kartverket:', CAST(1000 + n_nationkey AS VARCHAR(10)), '_', n_name, '_Properties.xlsx') AS source,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN '  '
       ELSE CONCAT('Kategori ', CAST(o_orderkey % 24 AS VARCHAR(10))) END AS forenklet_bygningskategori,
  CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Tatt i bruk' WHEN 2 THEN 'Bygning godkjent for riving/brenning'
       WHEN 3 THEN 'Midlertidig brukstillatelse' WHEN 4 THEN '' ELSE 'Ferdigattest' END AS bygningsstatus,
  CASE o_orderkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'TEK17' WHEN 3 THEN 'TEK10' WHEN 4 THEN 'TEK07'
       WHEN 5 THEN 'TEK97' WHEN 6 THEN 'BF87' WHEN 7 THEN 'BF85' WHEN 8 THEN 'BF69' WHEN 9 THEN 'BF49' ELSE 'Pre-1949' END AS tek_standard,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey * 7919 % 50021 AS DOUBLE) END AS bruksareal_totalt,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CONCAT('Gate ', CAST(o_orderkey AS VARCHAR(10))) END AS adresse,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE CONCAT('Gate ', CAST(o_custkey AS VARCHAR(10))) END AS adressenavn,
  CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE CAST(58 + o_orderkey % 13 AS DOUBLE) END AS lat,
  CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE CAST(5 + o_orderkey % 25 AS DOUBLE) END AS lon,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS vannforsynings_kode_id,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS avlops_kode_id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '1;2' END AS oppvarmings_kode_ids,
  CASE WHEN o_orderkey % 6 <> 1 THEN NULL ELSE '4' END AS energikilde_kode_ids,
  CASE WHEN o_orderkey % 18 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END END AS har_sefrakminne,
  CASE WHEN o_orderkey % 43 = 0 THEN 1 ELSE 0 END AS har_kulturminne,
  CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE 0 END AS skjermingsverdig,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS antall_underenheter,
  CAST(1 + o_custkey % 3 AS INT) AS antall_eiere,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CONCAT('Lager ', CAST(o_orderkey % 50 AS VARCHAR(10)), ' [Lagring, 52.1]') END AS underenheter
""" + _FROM


def duck_fixture(sql: str) -> str:
    """The fixture SQL with plain table names, for DuckDB."""
    return sql.format(orders="orders", customer="customer", nation="nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(
        sql,
        orders=table(spark, sf_dir, "orders"),
        customer=table(spark, sf_dir, "customer"),
        nation=table(spark, sf_dir, "nation"),
    )


def fx_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building-ownership sheet rows (pipeline input), one per order."""
    return _derive(spark, sf_dir, FX_RAW_SQL)


def fx_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded ``properties`` rows (report input), one per order."""
    return _derive(spark, sf_dir, FX_PROPS_SQL)
