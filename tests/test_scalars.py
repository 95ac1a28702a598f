"""Unit goldens for the scalar Column functions."""

import urllib.parse

import pytest
from pyspark.sql import functions as F

from muniprop.functions import dims
from muniprop.functions import scalars as S


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "date,expected",
    [
        ("2015-03-12", ("TEK10", "1. jul 2010", "2010–2017")),
        ("1975-06-15", ("BF69", "1. aug 1969", "1969–1985")),
        (None, ("", "", "")),
        ("", ("", "", "")),
        ("bad-date", ("", "", "")),
        ("2015-3-12", ("", "", "")),
        ("2015-02-30", ("", "", "")),
        (" 2015-03-12", ("", "", "")),
        ("1900-01-01", ("Pre-1949", "Før 1949", "Før 1949")),
        ("2017-07-01T00:00:00", ("TEK17", "1. jul 2017", "2017–i dag")),
    ],
)
def test_regulation_goldens(spark, date, expected):
    std, inf, per = S.regulation(F.col("v"))
    row = spark.createDataFrame([(date,)], "v string").select(std.alias("a"), inf.alias("b"), per.alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == expected


def test_regulation_both_sides_of_every_cutoff(spark):
    import datetime as dt

    rows = []
    for name, start, _, _ in dims.REGULATIONS:
        rows.append((start.isoformat(), name))
        before = (start - dt.timedelta(days=1)).isoformat()
        rows.append((before, None))
    df = spark.createDataFrame([(d,) for d, _ in rows], "v string").select("v", S.regulation("v")[0].alias("std"))
    got = {r["v"]: r["std"] for r in df.collect()}
    ordered = [n for n, *_ in dims.REGULATIONS]
    for name, start, _, _ in dims.REGULATIONS:
        assert got[start.isoformat()] == name
        before = got[(start - dt.timedelta(days=1)).isoformat()]
        i = ordered.index(name)
        assert before == (ordered[i + 1] if i + 1 < len(ordered) else "Pre-1949")


def test_code_tables():
    assert len(dims.INTERNAL_ID_TO_NS3457) == 128
    assert dims.INTERNAL_ID_TO_NS3457[104] == 671
    assert dims.INTERNAL_ID_TO_NS3457[1] == 111
    assert dims.INTERNAL_ID_TO_NS3457[127] == 999
    assert dims.INTERNAL_ID_TO_NS3457[0] is None
    assert dims.hierarchy_of(671) == ("Kultur- og forskningsbygning", "Bygning for religiøse aktiviteter", "Kirke, kapell")
    assert dims.hierarchy_of(330) == ("Kontor- og forretningsbygning", "", "Messe- og kongressbygning")
    assert dims.hierarchy_of(999) == ("", "", "Ukjent bygningstype")
    assert dims.SIMPLIFIED_CATEGORY[613] == "Skoler"
    assert dims.SIMPLIFIED_CATEGORY[721] == "Sykehjem og omsorgsboliger"
    assert dims.SIMPLIFIED_CATEGORY[193] == "Asylmottak"
    assert len(dims.SIMPLIFIED_CATEGORY) == 127
    assert len(set(dims.SIMPLIFIED_CATEGORY.values())) == 24


def test_type_name_goldens(spark):
    df = spark.createDataFrame([(1,), (104,)], "iid int").join(dims.building_types(spark), F.col("iid") == F.col("bt_internal_id"))
    got = {r["iid"]: r["n"] for r in df.select("iid", S.type_name("bt_hovedgruppe", "bt_bygningsgruppe", "bt_bygningstype").alias("n")).collect()}
    assert got == {1: "Enebolig", 104: "Kirke, kapell"}


@pytest.mark.parametrize("text", ["Gate 1 0150 Oslo", "Ærfuglveien 3/5 ~x *y +z", "a&b=c?d#e", "  ", "plain"])
def test_percent_encode_matches_python_quote(spark, text):
    assert one(spark, S.percent_encode(F.col("v")), text) == urllib.parse.quote(text)


def test_duck_round_matches_duckdb(spark):
    import duckdb

    values = [1.005, 2.675, 0.125, 0.25, -0.125, 12.345, 6.655, 99.995, 1 / 3, 2 / 3 * 100]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(S.duck_round("v", 2)).collect()]
    want = [duckdb.sql(f"SELECT ROUND({v!r}::DOUBLE, 2)").fetchall()[0][0] for v in values]
    assert got == want
    assert got[0] == 1.0  # 1.005 is 1.00499999... in binary


def test_key_forms_differ(spark):
    # F01 removes ' Kommune' anywhere (case as written); F02 lowers first and strips one suffix.
    assert one(spark, S.kommune_key(F.col("v")), "Nord Kommune Vest") == "nord vest"
    assert one(spark, S.kommune_key(F.col("v")), "OSLO KOMMUNE") == "oslo kommune"
    assert one(spark, S.selected_key(F.col("v")), "OSLO  KOMMUNE") == "oslo"
    assert one(spark, S.kommune_label(F.col("v")), "  ") == "Ukjent Kommune"
    assert one(spark, S.kommune_label(F.col("v")), "Bergen  kommune") == "Bergen kommune"
    assert one(spark, S.kommune_label(F.col("v")), "Bergen") == "Bergen Kommune"


def test_lists_and_numbers(spark):
    assert one(spark, S.split_list(F.col("v")), " a; b,, c ;") == ["a", "b", "c"]
    assert one(spark, S.split_list(F.col("v")), "NaN") == []
    assert one(spark, S.split_list(F.col("v")), " - ") == []
    assert one(spark, S.code_ids(F.col("v")), "0; 11") == [0, 11]
    assert one(spark, S.parse_percent(F.col("v")), "approx -12.5 %") == -12.5
    assert one(spark, S.parse_percent(F.col("v")), "-") is None
    assert one(spark, S.tolerant_int(F.col("v")), " 721.9 ") == 721
    assert one(spark, S.tolerant_int(F.col("v")), "-3.7") == -3
    assert one(spark, S.tolerant_int(F.col("v")), "nan") is None
    assert one(spark, S.postal_int(F.col("v")), "0150") == "150"
    assert one(spark, S.postal_text(F.col("v")), "0150") == "0150"


def test_addresses(spark):
    df = spark.createDataFrame([("Gate 1", 12.0, "0150", "OSLO"), ("Gate 2", None, None, "-"), (None, 3.0, "1", "X")], "n string, k double, p string, s string")
    got = [r[0] for r in df.select(S.full_address("n", "k", "p", "s")).collect()]
    assert got == ["Gate 1 12, 0150 OSLO", "Gate 2", ""]
    got = [r[0] for r in df.select(S.address("n", "k")).collect()]
    assert got == ["Gate 1 12", "Gate 2", ""]
    assert one(spark, S.short_property_id(F.col("v")), "301-1-2-0-0") == "301-1-2"
    assert one(spark, S.short_property_id(F.col("v")), "301-1") == "301-1"


def test_subunits(spark):
    v = "Skole 1 [Utdanning, grunnskole, 85.201]; Kantine;  ; Lager [Lagring, 52]"
    parsed = one(spark, S.parse_subunits(F.col("v")), v)
    assert [(e["name"], e["industry"], e["code"]) for e in parsed] == [
        ("Skole 1", "Utdanning, grunnskole", "85.201"),
        ("Kantine", "", ""),
        ("Lager", "Lagring", "52"),
    ]
    assert one(spark, S.render_subunits(S.parse_subunits(F.col("v"))), v) == "Skole 1 [Utdanning, grunnskole, 85.201]; Kantine; Lager [Lagring, 52]"
    assert one(spark, S.parse_subunits(F.col("v")), "nan") == []


def test_age_band(spark):
    df = spark.createDataFrame([(t,) for t in ["TEK17", "TEK97", "BF49", "Pre-1949", "", None]], "t string")
    assert [r[0] for r in df.select(S.age_band("t")).collect()] == ["2010+", "1997-2009", "Pre-1997", "Unknown", "Unknown", "Unknown"]
