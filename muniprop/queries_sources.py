"""Registered source/sink queries (S01-S14, P11) and bounded-SQL queries (Q01-Q08)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muniprop import fixtures as fx
from muniprop.operators.enrich import split_status
from muniprop.plans import pipeline as PL
from muniprop.plans import sqlapi as Q
from muniprop.queries import register
from muniprop.session import scratch_path
from muniprop.sources import export as X
from muniprop.sources import hashing as H
from muniprop.sources import incremental as I
from muniprop.sources import manifest as M
from muniprop.sources import properties as SP
from muniprop.sources import sheet_columns as SC

FILE_DIR = "/data/kartverket/"

# Extra file names exercising the naming rules next to the real sources: a lock file, an
# imputed variant, a '___' county suffix, the same name under a second number, a non-sheet.
EXTRA_FILES = [
    "~$1003_NATION_3_Properties.xlsx",
    "1003_NATION_3_Properties_Imputed.xlsx",
    "1099_Heroy___Nordland_Properties.xlsx",
    "2003_NATION_3_Properties.xlsx",
    "1098_Sor_Fron_properties_imputed.xlsx",
    "readme.txt",
]


# Columns of the scan query: all that the fixture has, with the shapes real sheets bring.
S01_COLUMNS = {
    "kommunenummer", "gardsnummer", "bruksnummer", "bygningstype_kode_id", "bygningstype_kode_ssb", "bygningsstatus_kode_id",
    "tidligste_status_dato", "bruksareal_totalt", "adressenavn", "nummer", "postnummer", "poststed", "alt_adresser", "alle_eiere",
    "alle_eierforhold_kode_ids", "alle_eierandeler", "underenheter", "antall_underenheter", "antall_eiere", "lat", "lon",
    "vannforsynings_kode_id", "avlops_kode_id", "har_sefrakminne", "har_kulturminne", "duplikat_gruppe",
}

# Sheet text of some columns over the fixture (the same SQL in both engines).
S01_EXTRA_SQL = {
    "kommunenummer": "CONCAT(CAST(kommunenummer AS VARCHAR(10)), '.0')",
    "nummer": "CASE WHEN nummer IS NULL THEN NULL WHEN row_no % 5 = 0 THEN CONCAT(CAST(CAST(nummer AS INT) AS VARCHAR(10)), 'B') ELSE CONCAT(CAST(CAST(nummer AS INT) AS VARCHAR(10)), '.0') END",
    "antall_eiere": "CAST(1 + row_no % 3 AS VARCHAR(10))",
    "lat": "CASE WHEN row_no % 15 = 0 THEN NULL ELSE CONCAT(CAST(58 + row_no % 13 AS VARCHAR(10)), '.5') END",
    "lon": "CAST(5 + row_no % 25 AS VARCHAR(10))",
    "vannforsynings_kode_id": "CASE WHEN row_no % 4 = 0 THEN NULL ELSE CONCAT(CAST(row_no % 5 AS VARCHAR(10)), '.0') END",
    "avlops_kode_id": "CAST(row_no % 5 AS VARCHAR(10))",
    "har_sefrakminne": "CASE WHEN row_no % 41 = 0 THEN '1' ELSE '0.0' END",
    "har_kulturminne": "CASE WHEN row_no % 43 = 0 THEN '1' ELSE '0' END",
}


def s01_extra() -> dict:
    return {k: F.expr(v) for k, v in S01_EXTRA_SQL.items()}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing: every distinct source of the fixture plus the extra names."""
    names = fx.fx_raw(spark, sf_dir).select(F.regexp_replace("source", "^kartverket:", "").alias("name")).distinct()
    extra = spark.createDataFrame([(n,) for n in EXTRA_FILES], "name STRING")
    return names.unionByName(extra).select(F.concat(F.lit(FILE_DIR), "name").alias("path"))


def register_tables(spark: SparkSession, sf_dir: str, names=fx.DRIVER_TABLES) -> None:
    for t in names:
        fx.table(spark, sf_dir, t).createOrReplaceTempView(t)


# Sheet headers used by the scan query, in two orders; the second kind of sheet lacks the sub-units.
S01_FIELDS = [c for c in SC.SHEET_HEADERS if c in S01_COLUMNS]

# Cells as sheets hold them: line breaks, quotes and separators inside (the same SQL in both engines).
S01_EXTRA_SQL |= {
    "adressenavn": "CASE WHEN row_no % 21 = 4 THEN CONCAT(adressenavn, ' \"Nord\"', CHR(10), 'oppgang 2, bakgård') "
    "WHEN row_no % 21 = 5 THEN CONCAT(',', adressenavn, '\"') WHEN row_no % 21 = 7 THEN CONCAT(adressenavn, CHR(13), CHR(10), 'bygg;3') ELSE adressenavn END",
}


def sheet_line(fields: list[str], extra: dict[str, str] = S01_EXTRA_SQL) -> str:
    """SQL of a row's line in a CSV sheet: every cell in quotes, null cells empty."""
    def cell(f: str) -> str:
        text = f"CAST({extra.get(f, f)} AS VARCHAR(2000))"
        return f"COALESCE('\"' || REPLACE({text}, '\"', '\"\"') || '\"', '')"

    return "CONCAT(" + ", ',', ".join(cell(f) for f in fields) + ")"


def header_line(fields: list[str]) -> str:
    return ",".join(SC.SHEET_HEADERS[f] for f in fields)


def write_sheets(rows: DataFrame, fields: list[str], folder: str, extra: dict[str, str] = S01_EXTRA_SQL) -> None:
    """One CSV file per source (folder ``sheet=NAME``): header, then the rows in ``row_no`` order."""
    sheet = F.regexp_replace("source", "^kartverket:", "").alias("sheet")
    lines = rows.select(sheet, F.col("row_no").alias("_at"), F.expr(sheet_line(fields, extra)).alias("value"))
    heads = rows.select(sheet).distinct().select("sheet", F.lit(-1).cast("bigint").alias("_at"), F.lit(header_line(fields)).alias("value"))
    every = lines.unionByName(heads).repartition("sheet").sortWithinPartitions("sheet", "_at")
    every.select("sheet", "value").write.mode("append").partitionBy("sheet").text(folder)


def s01_sheets(spark: SparkSession, sf_dir: str) -> str:
    """Writes the fixture as CSV sheets with real headers (numbers as floats, house numbers as
    text, a municipality name only in the file name) and returns their folder."""
    base = scratch_path(spark, f"s01-{uuid.uuid4().hex}")
    raw = fx.fx_raw(spark, sf_dir)
    odd = F.col("kommunenummer") % 2 == 1
    write_sheets(raw.where(odd), S01_FIELDS, f"{base}/a")
    write_sheets(raw.where(~odd), [f for f in reversed(S01_FIELDS) if f != "underenheter"], f"{base}/b")
    return base


@register("s01_scan")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = s01_sheets(spark, sf_dir)
    scanned = SP.scan_sources(spark, [f"{base}/a/*/*.txt", f"{base}/b/*/*.txt"], "csv", sheet_folder=True)
    return scanned.select("source", "kommune_name", *S01_FIELDS)


# The per-source build: the first state of the sheets, and the second, in which one sheet has fewer
# rows, one is gone, one is new and one has the bytes of another under a new name.
INC_FIELDS = [c for c in SC.SHEET_HEADERS if c in S01_COLUMNS | {"duplikat_flagg"}]
INC_EXTRA_SQL = {k: v for k, v in S01_EXTRA_SQL.items() if k != "nummer"}
INC_CHANGED, INC_GONE, INC_NEW = 1003, 1005, 1007
INC_SECOND_SQL = f"kommunenummer <> {INC_GONE} AND NOT (kommunenummer = {INC_CHANGED} AND row_no % 2 = 0)"


_BUILT: dict[tuple[str, str], tuple[str, I.Build]] = {}


def second_build(spark: SparkSession, sf_dir: str) -> tuple[str, I.Build]:
    """Two builds over sheets that change in between; returns the table's root and the second. The
    queries that look at it share one in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = _two_builds(spark, sf_dir)
    return _BUILT[key]


def _two_builds(spark: SparkSession, sf_dir: str) -> tuple[str, I.Build]:
    base = scratch_path(spark, f"incremental-{uuid.uuid4().hex}")
    rows, root = fx.fx_raw(spark, sf_dir), f"{base}/table"
    number = F.col("kommunenummer")
    same = rows.where(~number.isin(INC_CHANGED, INC_GONE, INC_NEW))
    write_sheets(same, INC_FIELDS, f"{base}/same", INC_EXTRA_SQL)
    write_sheets(rows.where(number.isin(INC_CHANGED, INC_GONE)), INC_FIELDS, f"{base}/first", INC_EXTRA_SQL)
    I.build_sources(spark, [f"{base}/same/*/*.txt", f"{base}/first/*/*.txt"], root, sheet_folder=True)
    changed = rows.where(number.isin(INC_CHANGED, INC_NEW)).where(INC_SECOND_SQL)
    write_sheets(changed, INC_FIELDS, f"{base}/second", INC_EXTRA_SQL)
    twin = rows.where(number == 1001).withColumn("source", F.lit("kartverket:9001_TWIN_Properties.xlsx"))
    write_sheets(twin, INC_FIELDS, f"{base}/second", INC_EXTRA_SQL)
    return root, I.build_sources(spark, [f"{base}/same/*/*.txt", f"{base}/second/*/*.txt"], root, sheet_folder=True)


@register("s13_incremental_build")
def s13_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = second_build(spark, sf_dir)
    table = I.read_table(spark, root, with_id=True)
    return table.select(
        "id", "source", "row_no", F.col("build").cast("int").alias("build"), "kommune", "adresse", "alt_adresser", "knr_gnr_bnr", "tek_standard",
        "forenklet_bygningskategori", "underenheter", F.col("antall_underenheter").cast("int").alias("antall_underenheter"),
    )


@register("d07_statistics_with_hash")
def d07_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = second_build(spark, sf_dir)
    return I.read_statistics(spark, root).withColumnRenamed("sha256", "file_hash")


@register("s11_file_dedup")
def s11_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, build = second_build(spark, sf_dir)
    names = build.state.select("source", "sha256", M.sheet_name(F.col("stored_as"), True).alias("stored_as"), F.col("made").isNotNull().alias("is_stored"))
    return names


@register("s02_manifest")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.manifest(files(spark, sf_dir))


@register("s03_candidates")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.array_join(M.candidates(F.col("path")), "|").alias("candidates"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.fx_raw(spark, sf_dir)
    extra = spark.createDataFrame([("Heroy",), ("nordland",), ("Sor Fron",), ("Nowhere",)], "kommune_name STRING")
    return raw.select("kommune_name").unionByName(extra)


@register("s04_resolve")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.resolve(files(spark, sf_dir), _targets(spark, sf_dir))


@register("s05_variant")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.manifest(files(spark, sf_dir))
    return m.where(F.col("variant") == "imputed").select("path", "variant")


@register("s06_municipalities")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.available_kommuner(files(spark, sf_dir))


@register("s07_resolve_label")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = fx.fx_props(spark, sf_dir).select(F.col("kommune").alias("value"))
    raw = fx.fx_raw(spark, sf_dir).select(F.replace("kommune_name", F.lit("_"), F.lit(" ")).alias("value"))
    values = props.unionByName(raw).distinct()
    return M.resolve_label(values, M.available_kommuner(files(spark, sf_dir)))


@register("s08_properties")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.build_properties(fx.fx_raw(spark, sf_dir), with_id=False).select("row_no", "source", "kommune", "kommune_key", "adresse")


@register("s09_row_id")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"s09-{uuid.uuid4().hex}")
    SP.load_properties(fx.fx_raw(spark, sf_dir), path)
    return SP.read_properties(spark, path).select("id", "source", "row_no")


@register("s10_load_report")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.fx_raw(spark, sf_dir)
    included, _ = split_status(PL.filtered_path(raw))
    from muniprop.operators.subunits import merge_subunits

    empty = spark.range(1).select(F.lit("kartverket:9999_EMPTY_Properties.xlsx").alias("source"))
    return SP.load_report(included, merge_subunits(included), raw.select("source").distinct().unionByName(empty))


@register("s11_content_dedup")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.content_dedup(fx.table(spark, sf_dir, "documents"))


@register("s12_fingerprint")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [H.fingerprint(fx.table(spark, sf_dir, t)).withColumn("table_name", F.lit(t)) for t in ("region", "nation", "customer")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("s12_changed_buckets")
def s12_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a changed table differs: one customer's balance, per nation."""
    table = fx.table(spark, sf_dir, "customer")
    other = table.withColumn("c_acctbal", F.when(F.col("c_custkey") % 97 == 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    by = ("c_nationkey",)
    return H.changed_buckets(H.bucket_digests(table, by), H.bucket_digests(other, by), by)


@register("s13_materialise")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.fx_raw(spark, sf_dir)
    key = X.dataset_key(raw)
    stats = PL.statistics(raw)
    stored = X.materialise(stats, key, "v1", scratch_path(spark, "materialised-statistics"))
    return stored.select(*stats.columns)  # the rows read back for (content key, version)


@register("s14_json_safe")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.fx_raw(spark, sf_dir)
    safe = X.json_safe(raw.select("row_no", "bruksareal_totalt", "nummer"))
    return safe.select(
        "row_no",
        F.to_json("bruksareal_totalt").alias("bruksareal_json"),
        F.to_json("nummer").alias("nummer_json"),
    )


@register("p11_rename")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.fx_raw(spark, sf_dir).select("row_no", "kommunenummer", "gardsnummer", "bruksnummer", "adressenavn", "nummer", "postnummer", "poststed")
    return SC.rename_external(raw)


# ---------------------------------------------------------------- Q01 .. Q08
# Q03 (list tables) and Q04 (describe) read no rows; they are plain helpers of plans/sqlapi.py.

Q01_SQL = (
    "SELECT c_custkey, COUNT(*) AS orders, SUM(o_orderkey) AS key_sum FROM customer JOIN orders ON o_custkey = c_custkey "
    "GROUP BY c_custkey HAVING COUNT(*) >= ? ORDER BY c_custkey"
)
Q06_SQL = "SELECT c_nationkey, COUNT(*) AS customers, ROUND(SUM(c_acctbal), 2) AS balance FROM customer GROUP BY c_nationkey"
Q08_SQL = "SELECT o_orderpriority, COUNT(*) AS orders FROM orders GROUP BY o_orderpriority"
Q_LIMIT = 25  # bites at every scale


@register("q01_bounded_query")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["customer", "orders"])
    return Q.bounded_query(spark, Q01_SQL, [2], Q_LIMIT).frame


# Statements probing the read-only gate; the documents' texts are classified too.
GATE_PROBES = [
    "SELECT 1",
    "  with t as (select 1) select * from t",
    "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t",
    "WITH t AS (SELECT 'insert' AS w) SELECT * FROM t",
    "WITH t AS (SELECT load, cache FROM x) SELECT * FROM t",
    "WITH t AS (SELECT (1 + (2)) AS n) DELETE FROM x",
    'WITH t AS (SELECT 1 AS "update") SELECT "update" FROM t',
    "/* update later */ WITH t AS (SELECT 1) SELECT * FROM t -- drop it",
    "show tables",
    "DESCRIBE nation",
    "explain select 1",
    "pragma version",
    "INSERT INTO t VALUES (1)",
    "DROP TABLE nation",
    "-- comment\nSELECT 1",
    "(SELECT 1)",
    "",
    f"WITH t AS (SELECT {'(' * 30}1{')' * 30} AS n) SELECT n FROM t",
    f"WITH t AS (SELECT {'(' * 30}1{')' * 30} AS n) INSERT INTO x SELECT n FROM t",
    "WITH t AS (SELECT (1 AS n) SELECT n FROM t",
]


@register("q02_read_gate")
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.createDataFrame([(-(i + 1), s) for i, s in enumerate(GATE_PROBES)], "doc_id BIGINT, statement STRING")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("statement"))
    return probes.unionByName(docs).select("doc_id", Q.verdict_of(F.col("statement")).alias("verdict"))


@register("q05_preview")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["supplier"])
    return Q.preview(spark, "main.supplier")


@register("q06_published_query")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["customer"])
    return spark.table(Q.publish_query(spark, "nation_customers", Q06_SQL))


@register("q07_published_table")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["nation"])
    return spark.table(Q.publish_table(spark, "nation_published", "nation"))


@register("q08_read_published")
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["orders"])
    return Q.read_published(spark, Q.publish_query(spark, "order_priorities", Q08_SQL))
