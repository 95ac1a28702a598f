"""Sheets by records, the per-source build, bucketed fingerprints, and the one-scan lists."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from muniprop import fixtures as fx
from muniprop.operators import reports as R
from muniprop.operators.subunits import entry_lists, merge_subunits
from muniprop.plans import package as P
from muniprop.plans import pipeline as PL
from muniprop.sources import hashing as H
from muniprop.sources import incremental as I
from muniprop.sources import properties as SP
from muniprop.sources import sheets

HEAD = ["Kommunenummer", "Gardsnummer", "Bruksnummer", "AlleEiere", "AlleEierforholdKodeIds", "AlleEierandeler", "Adressenavn", "Nummer"]


def sheet(name, n, owner="KOMMUNE", start=0):
    rows = [[str(301), str(i % 3), "2", f"{name.upper()} {owner}", "0", "100.0%", f'"Gate ""{i}"", øst\nbak"', str(i)] for i in range(start, start + n)]
    return "\n".join([",".join(HEAD), *[",".join(r) for r in rows]]) + "\n"


def put(folder, number, name, text):
    folder.mkdir(exist_ok=True)
    path = folder / f"{number}_{name}_Properties.csv"
    path.write_text(text, encoding="utf-8", newline="")
    return path


def names(frame):
    return sorted(os.path.basename(p).split("_")[1] for p in frame.inputFiles())


def content(table):
    return sorted(map(str, table.drop("build").select(sorted(c for c in table.columns if c != "build")).collect()))


def test_second_build_reads_new_and_changed_sheets_only(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "table")
    for number, name, n in ((1, "Oslo", 5), (2, "Bergen", 4), (3, "Voss", 3), (4, "Bodo", 2)):
        put(folder, f"000{number}", name, sheet(name, n))
    first = I.build_sources(spark, str(folder), root)
    assert first.number == 1 and names(first.read) == ["Bergen", "Bodo", "Oslo", "Voss"]

    put(folder, "0002", "Bergen", sheet("Bergen", 7, start=2))  # changed
    put(folder, "0005", "Alta", sheet("Alta", 3))  # new
    (folder / "0003_Voss_Properties.csv").unlink()  # gone
    put(folder, "0009", "Tvilling", sheet("Oslo", 5))  # the bytes of another sheet
    os.utime(folder / "0004_Bodo_Properties.csv", (1, 1))  # touched, same bytes
    second = I.build_sources(spark, str(folder), root)
    assert names(second.read) == ["Alta", "Bergen"]
    state = {r["source"].split("_")[1]: r for r in second.state.collect()}
    assert {k: r["made"] for k, r in state.items()} == {"Oslo": 1, "Bodo": 1, "Bergen": 2, "Alta": 2, "Tvilling": None}
    assert state["Tvilling"]["stored_as"].endswith("0001_Oslo_Properties.csv")
    assert {k: r["total_rows"] for k, r in state.items()} == {"Oslo": 5, "Bodo": 2, "Bergen": 7, "Alta": 3, "Tvilling": None}

    table = I.read_table(spark, root, with_id=True)
    full = str(tmp_path / "full")
    I.build_sources(spark, str(folder), full)
    again = I.read_table(spark, full, with_id=True)
    assert content(table) == content(again) and len(content(table)) == 17
    assert sorted(r["id"] for r in table.select("id").collect()) == list(range(17))
    assert 'Gate "3", øst\nbak 3' in {r["adresse"] for r in table.collect()}
    prints = [sorted(map(tuple, I.source_fingerprints(spark, x).collect())) for x in (root, full)]
    assert prints[0] == prints[1] and len(prints[0]) == 4
    assert {r["source"].split("_")[1] for r in I.read_statistics(spark, root).collect()} == {"Oslo", "Bodo", "Bergen", "Alta"}

    third = I.build_sources(spark, str(folder), root)
    assert third.read is None and content(I.read_table(spark, root, with_id=True)) == content(again)
    assert I.drop_stale(spark, root, rewrite_above=1.0) == []  # rows of both builds are still needed
    assert content(I.read_table(spark, root, with_id=True)) == content(again)
    # Another version of the code makes all rows anew; what is left of the first is dropped.
    fourth = I.build_sources(spark, str(folder), root, version="2")
    assert names(fourth.read) == ["Alta", "Bergen", "Bodo", "Oslo"]
    assert I.drop_stale(spark, root) == [1, 2, 4]  # over half was superseded: written once more as build 5
    assert content(I.read_table(spark, root, with_id=True)) == content(again)


def test_a_lost_build_leaves_the_former_state(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", str(tmp_path / "table")
    put(folder, "0001", "Oslo", sheet("Oslo", 5))
    I.build_sources(spark, str(folder), root)
    before = content(I.read_table(spark, root))
    put(folder, "0002", "Bergen", sheet("Bergen", 4))
    with monkeypatch.context() as m:
        m.setattr(I, "statistics", lambda raw: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            I.build_sources(spark, str(folder), root)
    assert content(I.read_table(spark, root)) == before
    assert I.build_sources(spark, str(folder), root).number == 2
    assert I.read_table(spark, root).count() == 9


def test_half_superseded_tables_are_written_once_more(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "table")
    for n in (6, 7, 8):
        put(folder, "0001", "Oslo", sheet("Oslo", n))
        I.build_sources(spark, str(folder), root)
    before = content(I.read_table(spark, root, with_id=True))
    assert I.drop_stale(spark, root) == [1, 2, 3]
    assert content(I.read_table(spark, root, with_id=True)) == before and len(before) == 8


def test_cells_come_back_unchanged(spark, tmp_path):
    odd = ["a;b", "line\nbreak", 'say ""x""', "comma, inside", "\r\nstart", "", "  blank  ", "ø" * 70_000]
    rows = [f'301;1;2;"OSLO KOMMUNE";0;100.0%;"{x}";{i};"e{i}"' for i, x in enumerate(odd)]
    put(tmp_path / "in", "0301", "Oslo", "﻿" + ";".join([*HEAD, "Ekstra felt"]) + "\r\n" + "\r\n".join(rows) + "\r\n")
    put(tmp_path / "in", "0302", "Tom", ";".join(HEAD) + "\n")
    got = SP.scan_sources(spark, str(tmp_path / "in"), "csv", delimiter=";").orderBy("row_no").collect()
    assert [r["adressenavn"] for r in got] == [x.replace('""', '"') or None for x in odd]
    assert [r["row_no"] for r in got] == list(range(len(odd)))
    assert got[3]["extra"] == {"Ekstra felt": "e3"} and got[0]["status_absent"] and got[0]["kommunenummer"] == 301


@pytest.mark.parametrize("block", [1, 1000, 1 << 20])
def test_larger_sheets_are_read_block_by_block(spark, tmp_path, monkeypatch, block):
    odd = ["line\nbreak", 'say ""x""', "comma, inside", "\r\nstart", "", "\n\n\n", "\r", "ø" * 3000]
    rows = [f'301;1;2;"OSLO KOMMUNE";0;100.0%;"{odd[i % 7 if i != 50 else 7]}";{i};"e{i}"' for i in range(200)]
    head = ";".join([*HEAD, '"Ekstra\nfelt"'])
    put(tmp_path / "in", "0301", "Oslo", "\ufeff" + head + "\r\n" + "\r\n".join(rows) + "\r\n")
    put(tmp_path / "in", "0302", "Bergen", head + "\n\n" + "\n\n".join(rows[:90]))
    put(tmp_path / "in", "0303", "Tom", head + "\n")
    monkeypatch.setattr(sheets, "BLOCK", block, raising=False)

    def scanned():
        return sorted(map(str, SP.scan_sources(spark, str(tmp_path / "in"), "csv", delimiter=";").collect()))

    whole = scanned()
    monkeypatch.setattr(sheets, "WHOLE_FILE", 50, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # no file may be read whole
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert scanned() == whole and len(whole) == 290
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", [",".join(HEAD) + "\n301,1,2\n", "Kommunenummer\n301\n"])
def test_faulty_sheets_are_errors(spark, tmp_path, text):
    put(tmp_path / "in", "0301", "Oslo", text)
    with pytest.raises(PythonException):
        SP.scan_sources(spark, str(tmp_path / "in"), "csv").count()


def test_larger_faulty_sheets_are_errors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "WHOLE_FILE", 50, raising=False)
    put(tmp_path / "in", "0301", "Oslo", sheet("Oslo", 20) + "301,1,2\n")
    with pytest.raises(PythonException, match="Expected 8 columns, got 3"):
        SP.scan_sources(spark, str(tmp_path / "in"), "csv").count()


def test_larger_parquet_sheets_are_read_alike(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    base = {h: ["x"] * 3000 for h in HEAD} | {"AlleEiere": [f"Oslo kommune {i}" for i in range(3000)]}
    for number, numbers in ((1, [str(i) for i in range(3000)]), (2, [i / 2 for i in range(3000)])):
        pq.write_table(pa.table({**base, **dict.fromkeys(HEAD[:3], pa.array(numbers))}), tmp_path / "in" / f"000{number}_Oslo_Properties.parquet")
    whole = sorted(map(str, SP.scan_sources(spark, str(tmp_path / "in")).collect()))
    monkeypatch.setattr(sheets, "WHOLE_FILE", 50, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert sorted(map(str, SP.scan_sources(spark, str(tmp_path / "in")).collect())) == whole and len(whole) == 6000
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_parquet_sheets_whose_schemas_do_not_merge(spark, tmp_path):
    (tmp_path / "in").mkdir()
    base = {h: ["x"] for h in HEAD} | {"AlleEiere": ["Oslo kommune"], "AlleEierforholdKodeIds": ["0"], "AlleEierandeler": ["100%"]}
    for number, numbers in ((1, pa.array(["301"])), (2, pa.array([301.0])), (3, pa.array([301]))):
        table = {**base, "Kommunenummer": numbers, "Gardsnummer": numbers, "Bruksnummer": numbers, "Nummer": numbers}
        pq.write_table(pa.table(table), tmp_path / "in" / f"000{number}_Oslo_Properties.parquet")
    got = SP.scan_sources(spark, str(tmp_path / "in")).collect()
    assert [(r["kommunenummer"], r["bruksnummer"]) for r in got] == [(301, 301)] * 3
    assert {r["adresse"] for r in PL.filtered_path(SP.scan_sources(spark, str(tmp_path / "in"))).collect()} == {"x 301"}


def test_file_and_line_hashes(spark, tmp_path):
    a, b = (put(tmp_path / "in", n, "Oslo", sheet("Oslo", 40)) for n in ("0001", "0002"))
    put(tmp_path / "in", "0003", "Voss", sheet("Voss", 40))
    files = H.file_hashes(spark.read.format("binaryFile").load(str(tmp_path / "in")))
    import hashlib

    assert {r["sha256"] for r in files.where("path like '%0001%'").collect()} == {hashlib.sha256(a.read_bytes()).hexdigest()}
    assert sorted(r["copies"] for r in H.distinct_files(files).collect()) == [1, 2, 2]
    lines = {r["path"][-8:]: r["sha256"] for r in H.line_hashes(spark, [str(tmp_path / "in")]).selectExpr("right(replace(path, '_Properties.csv', ''), 8) as path", "sha256").collect()}
    assert len(lines) == 3 and len(set(lines.values())) == 2
    assert b.exists()


def test_files_of_any_size_are_hashed(spark, tmp_path, monkeypatch):
    import hashlib

    mark, text = b"\xef\xbb\xbf", b"a,b\r\n1,\xff\xfe\n\n3,4\r\n" * 3000
    texts = {"a b%20+\u00e6[1]{x}.csv": mark + text + b"end", "b.csv.gz": text, "no_dot": bytes(50_000), "lines": b"\n" * 40_001, "mark": mark * 2 + text, "exact": b"a" * 16_384, "small": b"hei"}
    (tmp_path / "in").mkdir()
    for name, content in texts.items():
        (tmp_path / "in" / name).write_bytes(content)
    monkeypatch.setattr(H, "WHOLE_FILE", 1000)
    at = str(tmp_path / "in")
    files = spark.read.format("binaryFile").load([at, f"{at}/lines", f"{at}/small"])  # two are listed twice
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits a file
    try:
        hashes = H.file_hashes(files).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(n, len(texts[n]), hashlib.sha256(texts[n]).hexdigest()) for n in [*texts, "lines", "small"]]
    assert sorted((os.path.basename(r["path"]), r["length"], r["sha256"]) for r in hashes) == sorted(want)
    listed = files.select("path", "length", "modificationTime").collect()
    assert sorted(map(str, listed)) == sorted(str(type(listed[0])(**{k: r[k] for k in ("path", "length", "modificationTime")})) for r in hashes)


def test_a_build_holds_files_of_any_size(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "0001", "Oslo", sheet("Oslo", 40))
    put(tmp_path / "in", "0002", "Voss", sheet("Voss", 2))
    monkeypatch.setattr(H, "WHOLE_FILE", 500)
    for _ in range(2):  # the second finds nothing new
        built = I.build_sources(spark, str(tmp_path / "in"), str(tmp_path / "table"))
        assert {r["source"].split("_")[1]: r["total_rows"] for r in built.state.collect()} == {"Oslo": 40, "Voss": 2}
    assert built.read is None and I.read_statistics(spark, str(tmp_path / "table")).where("sha256 is null").count() == 0


def test_one_changed_row_changes_its_buckets_only(spark, sf_dir):
    table = fx.table(spark, sf_dir, "customer")
    old = H.bucket_digests(table)
    assert H.changed_buckets(old, H.bucket_digests(table.orderBy(F.rand(3)).repartition(5))).count() == 0
    one = table.withColumn("c_name", F.when(F.col("c_custkey") == 7, F.lit("?")).otherwise(F.col("c_name")))
    assert H.changed_buckets(old, H.bucket_digests(one)).count() in (1, 2)  # the bucket it left, the one it went to
    assert H.changed_buckets(old, H.bucket_digests(table.unionByName(table.where("c_custkey = 7")))).count() == 1
    assert H.fingerprint(table.where("false")).first()["row_count"] == 0


def test_first_entries_need_no_sort_aggregate_and_survive_a_hot_group(spark):
    rows = spark.range(9000).selectExpr(
        "id as row_no", "'s' as source", "case when id % 3 = 0 then 'HOT' else concat('G', id % 700) end as duplikat_gruppe",
        "case when id % 3 = 0 then concat('Leietaker ', id % 50, '; Kantine') else 'Lager [Lagring, 52.1]' end as underenheter",
        "concat('Gate ', id) as adresse", "case when id % 2 = 0 then 'Primary' else 'Duplicate' end as duplikat_flagg",
    )
    plan = entry_lists(rows)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    hot = merge_subunits(rows).where("duplikat_gruppe = 'HOT'").select("antall_underenheter", "underenheter").distinct().collect()
    assert [r["antall_underenheter"] for r in hot] == [51]
    assert hot[0]["underenheter"].startswith("Leietaker 0; Kantine; Leietaker 3; Leietaker 6")


def test_one_scan_lists_equal_the_single_reports(spark, sf_dir):
    props = R.with_key(fx.fx_props(spark, sf_dir))
    hot = props.withColumn(R.KEY, F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col(R.KEY))).cache()
    lists = R.detail_lists(hot).cache()
    single = {"problem": R.problem_properties(hot), "large": R.large_risks(hot), "heritage": R.heritage_rows(hot), "tenants": R.tenant_top(hot)}
    for name, want in single.items():
        got = lists.where(F.col("list") == name).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    top = R.top_properties(hot).drop("area_share_percent", "bygningsstatus", "tek_standard")
    got = lists.where("list = 'top'").select(top.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, top.collect()))


def test_packages_read_the_table_for_their_facts_only(spark, sf_dir, tmp_path):
    path = str(tmp_path / "props")
    R.with_key(fx.fx_props(spark, sf_dir)).write.partitionBy(R.KEY).parquet(path)
    props = spark.read.parquet(path)
    facts = P.package_facts(props, str(tmp_path / "facts"))
    read = P.underwriting_package(props, facts=facts).inputFiles()
    assert read and all("/facts/" in f for f in read)
    kept = P.underwriting_package(props, "NATION 3", P.read_facts(spark, str(tmp_path / "facts")))
    assert [r[R.KEY] for r in kept.collect()] == ["nation 3"]


def test_cells_that_hold_numbers_are_read_alike_in_one_pass(spark):
    from muniprop.sources.sheet_columns import read_as, read_cells

    cells = [None, "", " ", "12", " 12 ", " 12 ", "\t-7.9\n", "301.0", "1e3", "1e30", "NaN", " nan", "inf", "-Infinity", "12B", "1 2", "0x1", "5d"]
    names = ["lat", "kommunenummer", "poststed"]
    df = spark.createDataFrame([(i, c, c, c) for i, c in enumerate(cells)], "i int, lat string, kommunenummer string, poststed string")
    want = df.select("i", *[read_as(n, F.col(n)).alias(n) for n in names])
    got = read_cells(df, names).select("i", *names)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_build_makes_the_ownership_flag_once(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "0001", "Oslo", sheet("Oslo", 5))
    monkeypatch.setattr(PL, "with_ownership_flag", lambda raw: 1 / 0)  # the statistics take the stored flag
    built = I.build_sources(spark, str(tmp_path / "in"), str(tmp_path / "table"))
    assert [r["total_rows"] for r in built.state.collect()] == [5]
    assert not [c for c in I.read_table(spark, str(tmp_path / "table")).columns if c.startswith("_")]
