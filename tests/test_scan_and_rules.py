"""Sheets as they really come, and rules on values that the fixtures do not hold."""

import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from muniprop import fixtures as fx
from muniprop import session
from muniprop.functions import scalars as S
from muniprop.operators import reports as R
from muniprop.operators.ownership import ownership_filter
from muniprop.plans import sqlapi
from muniprop.sources import export as X
from muniprop.sources import hashing as H
from muniprop.sources import properties as SP
from muniprop.sources import sheet_columns as SC


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


HEAD = ["Kommunenummer", "Gardsnummer", "Bruksnummer", "AlleEiere", "AlleEierforholdKodeIds", "AlleEierandeler", "Adressenavn", "Nummer", "HarSefrakminne"]


def test_csv_sheets_are_read_by_name(spark, tmp_path):
    row = ["301.0", "1", "2.0", "OSLO KOMMUNE", "0", "100.0%", "Storgata", "12B", "1.0"]
    write(tmp_path / "in", "0301_Oslo_Properties.csv", ",".join(HEAD) + "\n" + ",".join(row) + "\n" + ",".join(row) + "\n")
    order = [8, 3, 1, 0, 2, 7, 6, 5, 4]
    write(tmp_path / "in", "4601_Bergen_Properties.csv", ",".join(HEAD[i] for i in order) + ",Ekstra\n" + ",".join(row[i].replace("OSLO", "BERGEN") for i in order) + ",x\n")
    got = {r["source"]: r for r in SP.scan_sources(spark, str(tmp_path / "in"), "csv").orderBy("row_no").collect()}
    for name in ("Oslo", "Bergen"):
        r = next(v for k, v in got.items() if name in k)
        assert (r["kommunenummer"], r["gardsnummer"], r["bruksnummer"], r["nummer"], r["har_sefrakminne"]) == (301, 1, 2, "12B", 1)
        assert r["kommune_name"] == name and r["adressenavn"] == "Storgata"
    scanned = SP.scan_sources(spark, str(tmp_path / "in"), "csv")
    assert sorted((r["source"], r["row_no"]) for r in scanned.collect()) == [
        ("kartverket:0301_Oslo_Properties.csv", 0), ("kartverket:0301_Oslo_Properties.csv", 1), ("kartverket:4601_Bergen_Properties.csv", 0),
    ]
    assert ownership_filter(scanned).count() == 3  # the non-breaking blank counts as white space
    built = SP.build_properties(scanned).collect()
    assert {r["adresse"] for r in built} == {"Storgata 12B"} and {r["knr_gnr_bnr"] for r in built} == {"301-1-2"}


def test_a_sheet_without_status_column_keeps_its_rows(spark, tmp_path):
    row = ["301", "1", "2", "OSLO KOMMUNE", "0", "100.0%", "Storgata", "12", "1"]
    write(tmp_path / "in", "0301_Oslo_Properties.csv", ",".join(HEAD) + "\n" + ",".join(row) + "\n")
    with_status = [x.replace("OSLO", "BERGEN") for x in row]
    write(tmp_path / "in", "4601_Bergen_Properties.csv", ",".join(HEAD) + ",BygningsstatusKodeId\n" + ",".join([*with_status, "999"]) + "\n")
    built = SP.build_properties(SP.scan_sources(spark, str(tmp_path / "in"), "csv")).collect()
    assert [r["kommune"] for r in built] == ["Oslo Kommune"]


def test_a_missing_required_column_is_an_error(spark, tmp_path):
    write(tmp_path / "in", "0301_Oslo_Properties.csv", "Kommunenummer,Adressenavn\n301,Gate\n")
    with pytest.raises(PythonException, match="AlleEiere"):  # found in the task that reads the file
        SP.scan_sources(spark, str(tmp_path / "in"), "csv").count()


def test_parquet_sheets_with_floats_and_part_files(spark, sf_dir, tmp_path):
    raw = fx.fx_raw(spark, sf_dir).limit(60).drop("row_no", "kommune_name")
    one = raw.withColumn("source", F.lit("1001_NATION_1_Properties.xlsx"))
    one.repartition(4).write.partitionBy("source").parquet(str(tmp_path / "a"))
    floats = one.withColumn("kommunenummer", F.col("kommunenummer").cast("double")).withColumnsRenamed(SC.SHEET_HEADERS).drop("source")
    floats.coalesce(1).write.parquet(str(tmp_path / "a" / "source=1002_NATION_2_Properties.xlsx"))
    got = SP.scan_sources(spark, [str(tmp_path / "a" / "*")], sheet_folder=True)
    per = {r["source"]: r for r in got.groupBy("source").agg(F.countDistinct("row_no").alias("d"), F.count("*").alias("n"), F.count("kommunenummer").alias("k"), F.min("kommune_name").alias("name")).collect()}
    assert {(r["d"], r["n"], r["k"]) for r in per.values()} == {(60, 60, 60)}
    assert {r["name"] for r in per.values()} == {"NATION 1", "NATION 2"}


def test_reports_see_what_the_sheets_hold(spark, sf_dir, tmp_path):
    """Scan, build and report equal the reports on rows built directly."""
    raw = fx.fx_raw(spark, sf_dir).withColumns({
        "har_sefrakminne": F.when(F.col("row_no") % 3 == 0, 1).otherwise(0).cast("bigint"),
        "lat": F.col("row_no") % 60 + 0.5, "lon": F.lit(5.5), "vannforsynings_kode_id": F.col("row_no") % 5,
        "avlops_kode_id": F.col("row_no") % 4, "bygningsstatus": F.lit("Tatt i bruk"), "antall_eiere": F.lit(2).cast("bigint"),
    })
    sheets = raw.withColumn("sheet", F.regexp_replace("source", "^kartverket:", "")).drop("source").withColumnsRenamed(SC.SHEET_HEADERS)
    sheets.write.partitionBy("sheet").parquet(str(tmp_path / "s"))
    scanned = SP.scan_sources(spark, str(tmp_path / "s" / "*"), sheet_folder=True)
    assert scanned.where(~F.col("row_no").isNotNull()).count() == 0
    a, b = (SP.build_properties(x).cache() for x in (raw, scanned))
    for report in (R.heritage_summary, R.tenant_summary, R.quality_fields, R.problem_properties):
        rows = [sorted(map(str, report(x).collect())) for x in (a, b)]
        assert rows[0] == rows[1]
    totals = b.agg(F.sum("har_sefrakminne"), F.count("lat"), F.count("bygningsstatus"), F.count("antall_eiere"), F.sum("vannforsynings_kode_id")).first()
    assert all(totals)


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr("v")).first()[0]


@pytest.mark.parametrize(("value", "text"), [("12B", "12B"), ("12.0", "12"), (" 7 ", "7"), ("", ""), (None, ""), ("1.5", "1.5"), ("007", "007")])
def test_house_numbers_as_text(spark, value, text):
    assert one(spark, value, S.house_number) == text


@pytest.mark.parametrize(("value", "text"), [(12.0, "12"), (12.5, "12.5"), (1e20, "1" + "0" * 20), (23456789.0, "23456789"), (float("nan"), ""), (None, "")])
def test_house_numbers_as_floats(spark, value, text):
    assert one(spark, value, S.house_number, "double") == text


def test_large_codes_do_not_end_the_job(spark):
    assert one(spark, "1e30", S.postal_int) == "1" + "0" * 30 and one(spark, "1e300", S.postal_int) == "1e300"
    assert one(spark, "0150", S.postal_int) == "150" and one(spark, "3000000000", S.tolerant_int) == 3_000_000_000
    assert [int(x) for x in one(spark, "0; 123456789012345678901", S.code_ids)] == [0, 123456789012345678901]


def test_unicode_white_space(spark):
    assert one(spark, " Nord  Fron ", S.name_norm) == "nord fron"
    assert one(spark, "Oslo kommune ", S.kommune_label) == "Oslo kommune"
    assert one(spark, "Oslo  Kommune", S.selected_key) == "oslo"
    assert one(spark, "a ; b", S.split_list) == ["a", "b"]


def test_no_hidden_caps(spark):
    n = 260
    rows = [(i, "Oslo Kommune" if i % 2 else "Oslo kommune", f"TEK{i}", f"Status {i} riving", float(i)) for i in range(n)]
    props = spark.createDataFrame(rows, "id bigint, kommune string, tek_standard string, bygningsstatus string, bruksareal_totalt double")
    assert R.tek_distribution(props).count() == n and R.status_distribution(props).count() == n
    assert R.tek_distribution(props, 5).count() == 5
    assert R.problem_statuses(R.status_distribution(props)).count() == n
    labels = props.withColumn("kommune", F.concat(F.lit("Oslo"), F.repeat(F.lit(" "), F.col("id").cast("int")), F.lit(" kommune")))
    assert R.by_kommune(labels).count() == n


def test_cumulative_share_without_area(spark):
    rows = [(i, "Oslo Kommune", None if i else 0.0, f"Gate {i}") for i in range(4)]
    props = spark.createDataFrame(rows, "id bigint, kommune string, bruksareal_totalt double, adresse string").withColumn("adressenavn", F.col("adresse"))
    top = R.top_properties(SP.conform(R.with_key(props)))
    assert {r["cumulative_share_percent"] for r in R.cumulative_share(top).collect()} == {0.0}


def test_package_of_one_municipality(spark, sf_dir):
    from muniprop.plans import package as P

    props = R.with_key(fx.fx_props(spark, sf_dir)).cache()
    facts = P.package_facts(props)
    whole = P.underwriting_package(props, facts=facts)
    one_key = props.where("kommune_key is not null").select("kommune_key").first()[0]
    got = P.underwriting_package(props, kommune=one_key, facts=facts).toJSON().collect()
    assert got == whole.where(F.col("kommune_key") == one_key).toJSON().collect() and len(got) == 1
    assert json.loads(got[0])["area_share_percent"] < 50  # of the whole portfolio


def test_fingerprints_tell_rows_apart(spark):
    prints = lambda rows, schema: H.fingerprint(spark.createDataFrame(rows, schema)).first()["fingerprint"]
    different = [
        prints([(None, "x")], "a string, b string"), prints([("\\N", "x")], "a string, b string"), prints([("", "x")], "a string, b string"),
        prints([("\u0001x", "")], "a string, b string"), prints([("", "\u0001x")], "a string, b string"), prints([(None, "x")], "a string, c string"),
        prints([(None, 1)], "a string, b int"), prints([(None, "1")], "a string, b string"),
    ]
    assert len(set(different)) == len(different)
    assert prints([("p", "1"), ("q", "2")], "a string, b string") == prints([("q", "2"), ("p", "1")], "a string, b string")


def test_json_export_keeps_nulls_and_large_numbers(spark):
    df = spark.createDataFrame([(1, None, 9.3e18), (2, "x", float("nan")), (3, "y", 1.5)], "id int, name string, v double")
    lines = [r["json"] for r in X.to_json_lines(df).orderBy("json").collect()]
    rows = [json.loads(x) for x in lines]
    assert rows == [{"id": 1, "name": None, "v": 9.3e18}, {"id": 2, "name": "x", "v": None}, {"id": 3, "name": "y", "v": 1.5}]


def test_materialise_is_one_folder_per_key(spark, tmp_path):
    path, df = str(tmp_path / "m"), spark.range(5).withColumn("a", F.lit(1))
    assert X.materialise(df.select("id"), "k", "v1", path).count() == 5
    assert X.materialise(spark.range(9), "k", "v1", path).count() == 5  # stored rows are reused
    wider = X.materialise(df, "k", "v1", path)  # a wanted column is absent: built again
    assert wider.count() == 5 and "a" in wider.columns
    assert X.materialise(spark.range(3), "k", "v2", path).count() == 3
    assert X.materialise(spark.range(2), "other", "v1", path).count() == 2


def test_only_published_names_are_read(spark):
    spark.range(3).createOrReplaceTempView("private_rows")
    with pytest.raises(FileNotFoundError):
        sqlapi.read_published(spark, "private_rows")
    sqlapi.publish_query(spark, "public_rows", "SELECT * FROM private_rows")
    assert sqlapi.read_published(spark, "public_rows").count() == 3


def test_load_report_lists_sources_without_rows(spark):
    data = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "source string, alt_adresser_fra_knr_gnr_bnr boolean")
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    got = {r["source"]: tuple(r)[1:] for r in SP.load_report(data, data.where("source = 'a'").limit(1), sources).collect()}
    assert got["b"] == (0, 1, 0) and got["c"] == (0, 0, 0) and got[None][:2] == (1, 2)


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    Context.master = "local-cluster[3,2,1000]"
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


@pytest.mark.parametrize(
    ("statement", "runs"),
    [
        (f"WITH t AS (SELECT {'(' * 30}1{')' * 30} AS n) SELECT n FROM t", True),
        ("WITH t AS (SELECT 1 AS `insert`) SELECT `insert` FROM t", True),
        (f"WITH t AS (SELECT {'(' * 30}1{')' * 30} AS n) INSERT INTO x SELECT n FROM t", False),
        ("WITH t AS (SELECT 1 AS n) DELETE FROM x", False),
        ("WITH a AS (SELECT 1 AS n) MERGE INTO x USING a ON x.n = a.n WHEN MATCHED THEN DELETE", False),
        ("INSERT INTO x VALUES (1)", False),
    ],
)
def test_the_parser_decides_what_runs(spark, statement, runs):
    assert sqlapi.may_run(spark, statement) == runs
