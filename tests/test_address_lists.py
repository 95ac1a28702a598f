"""Known addresses of a cadastre key are stored once per key, however many rows share it."""

from pyspark.sql import functions as F

from muniprop.operators.enrich import ALT_KEY, FLAG
from muniprop.plans import pipeline as PL
from muniprop.sources import incremental as I
from muniprop.sources import properties as SP

SOURCE = "kartverket:0301_Oslo_Properties.xlsx"


def rows_of_one_key(spark, n):
    """n rows with an address and n without, all of one cadastre key; every fifth has own alternates."""
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Gate "), F.sha2(F.col("id").cast("string"), 256)))
    return spark.range(2 * n).select(
        F.col("id").alias("row_no"), F.lit(SOURCE).alias("source"), F.lit("Oslo").alias("kommune_name"),
        F.lit(301).alias("kommunenummer"), F.lit(1).alias("gardsnummer"), F.lit(2).alias("bruksnummer"),
        F.lit("2").alias("bygningsstatus_kode_id"), name.alias("adressenavn"), F.lit(None).cast("double").alias("nummer"),
        F.lit("0150").alias("postnummer"), F.lit("OSLO").alias("poststed"),
        F.when(F.col("id") % 5 == 0, F.lit("Gammel vei 1; ;Gammel vei 1")).alias("alt_adresser"),
        F.lit("OSLO KOMMUNE").alias("alle_eiere"), F.lit("0").alias("alle_eierforhold_kode_ids"), F.lit("100.0%").alias("alle_eierandeler"),
    )


def expected(n):
    import hashlib

    known = [f"Gate {hashlib.sha256(str(i).encode()).hexdigest()}, 0150 OSLO" for i in range(0, 2 * n, 2)]
    own = lambda i: "Gammel vei 1; ;Gammel vei 1" if i % 5 == 0 else None
    return {i: own(i) if i % 2 == 0 else ";".join([*(["Gammel vei 1"] if i % 5 == 0 else []), *known]) for i in range(2 * n)}


def test_stored_table_holds_each_list_once(spark, tmp_path):
    n = 300
    path = str(tmp_path / "table")
    SP.load_properties(rows_of_one_key(spark, n), path)
    # Every address is stored once (about 80 bytes); a list in each of n rows would be 300 times that.
    held = spark.read.parquet(path).agg(F.sum(F.length("alt_adresser"))).first()[0]
    assert held == 120 * len("Gammel vei 1; ;Gammel vei 1")
    assert spark.read.parquet(SP.addresses_path(path)).agg(F.sum(F.size("found"))).first()[0] == n
    got = SP.read_properties(spark, path)
    assert {r["row_no"]: r["alt_adresser"] for r in got.collect()} == expected(n)
    plain = SP.build_properties(rows_of_one_key(spark, n), with_id=False)
    assert ALT_KEY not in got.columns and set(got.columns) == {*plain.columns, "id"}
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert got.where(FLAG).count() == n


def test_bundle_frames_render_lists_when_read(spark):
    n = 40
    raw = rows_of_one_key(spark, n).withColumn("alle_eiere", F.when(F.col("row_no") < n, F.lit("OSLO KOMMUNE")).otherwise(F.lit("Privat AS")))
    b = PL.build_bundle(raw)
    every = {r["row_no"]: r["alt_adresser"] for r in b.unfiltered.collect()}
    assert every == expected(n)
    owned = {r["row_no"]: r["alt_adresser"] for r in b.data.collect()}
    assert owned == {k: v for k, v in expected(n // 2).items()}
    assert [r[0] for r in b.data.select(FLAG).where("adressenavn is null").distinct().collect()] == [True]


def test_built_tables_tell_a_changed_list(spark, tmp_path):
    """The digests of a source change with a list that its rows share, and rows come back whole."""
    head = "Kommunenummer,Gardsnummer,Bruksnummer,AlleEiere,AlleEierforholdKodeIds,AlleEierandeler,Adressenavn,Nummer,BygningsstatusKodeId\n"
    prints = []
    for i, names in enumerate(("Gate 1", "Gate 1", "Gate 2")):
        folder = tmp_path / f"in{i}"
        folder.mkdir()
        # The second row, which status 99 leaves out of the table, gives the first its address.
        (folder / "0301_Oslo_Properties.csv").write_text(
            head + f"301,1,2,OSLO KOMMUNE,0,100.0%,,,2\n301,1,2,OSLO KOMMUNE,0,100.0%,{names},,99\n", encoding="utf-8"
        )
        I.build_sources(spark, str(folder), str(tmp_path / f"t{i}"))
        assert [r["alt_adresser"] for r in I.read_table(spark, str(tmp_path / f"t{i}"), with_id=True).collect()] == [names]
        prints.append(I.source_fingerprints(spark, str(tmp_path / f"t{i}")).collect())
    assert prints[0] == prints[1] != prints[2]
