"""Pipeline invariants: ownership truth table, complementary splits, idempotent dedup."""

from pyspark.sql import functions as F

from muniprop import fixtures as fx
from muniprop.operators.enrich import drop_duplicates_by_flag, split_status
from muniprop.operators.ownership import ownership_filter
from muniprop.plans import pipeline as PL
from muniprop.sources import hashing as H

KEPT_CASES = {0, 1, 2, 3, 4, 5, 7, 11, 12}


def test_ownership_truth_table(spark, sf_dir):
    raw = fx.fx_raw(spark, sf_dir)
    kept = ownership_filter(raw).select((F.col("row_no") % 16).alias("case")).distinct()
    assert {r["case"] for r in kept.collect()} == KEPT_CASES


def test_ownership_edge_rows(spark):
    rows = [
        ("Oslo", "Oslo kommune", "0", "100%", True),
        ("Oslo", "OSLO_KOMMUNE; oslo kommune", "0;0", "60%;60%", True),  # only the municipality: >100 allowed
        ("Oslo", "Oslo kommune; Per", "0;0", "100%;10%", False),  # others and total > 100
        ("Oslo", "Oslo kommune; Per", "0;0", "100%;0%", True),
        ("Oslo", "Oslo kommune", "1", "100%", False),  # not code 0
        ("Oslo", "Oslo kommune", "0", "99.9%", False),
        ("Oslo", "Oslo kommune; Per", "0", "100%;0%", False),  # misaligned
        ("Oslo", "Oslo kommune; Per", "0;0", "100%;x", False),  # unparsable share
        ("", "Oslo kommune", "0", "100%", False),
        (None, "Oslo kommune", "0", "100%", False),
    ]
    df = spark.createDataFrame(
        [(i, *r[:4]) for i, r in enumerate(rows)],
        "row_no long, kommune_name string, alle_eiere string, alle_eierforhold_kode_ids string, alle_eierandeler string",
    )
    got = {r["row_no"] for r in ownership_filter(df).collect()}
    assert got == {i for i, r in enumerate(rows) if r[4]}


def test_status_split_is_a_partition(spark, sf_dir):
    kept = ownership_filter(fx.fx_raw(spark, sf_dir))
    inc, exc = split_status(kept)
    n, a, b = kept.count(), inc.count(), exc.count()
    assert a + b == n
    assert inc.join(exc, "row_no").count() == 0


def test_dedup_idempotent(spark, sf_dir):
    raw = fx.fx_raw(spark, sf_dir)
    once = drop_duplicates_by_flag(raw)
    twice = drop_duplicates_by_flag(once)
    assert H.fingerprint(once).first() == H.fingerprint(twice).first()


def test_statistics_match_bundle_counts(spark, sf_dir):
    raw = fx.fx_raw(spark, sf_dir)
    stats = {r["source"]: r for r in PL.statistics(raw).collect()}
    b = PL.build_bundle(raw)
    dedup = {r["source"]: r["count"] for r in b.data_dedup.groupBy("source").count().collect()}
    for source, n in dedup.items():
        assert stats[source]["deduplicated_rows"] == n
    assert sum(r["unfiltered_rows"] for r in stats.values()) == raw.count()


def test_fingerprint_order_insensitive_and_duplicate_sensitive(spark, sf_dir):
    cust = fx.table(spark, sf_dir, "customer")
    a = H.fingerprint(cust).first()
    b = H.fingerprint(cust.orderBy(F.rand(7)).repartition(5)).first()
    c = H.fingerprint(cust.unionByName(cust.limit(1))).first()
    assert a == b
    assert a["fingerprint"] != c["fingerprint"]


def test_enriched_for_kommune_and_pending(spark, sf_dir):
    from muniprop.queries_sources import files
    from muniprop.sources.manifest import pending_sources

    raw = fx.fx_raw(spark, sf_dir)
    frame, stats = PL.enriched_for_kommune(raw, files(spark, sf_dir), "NATION 3")
    assert frame is not None and frame.select("source").distinct().count() == 1
    st = stats.first()
    assert st["total_rows"] - st["excluded_status_rows"] == frame.count()
    assert PL.enriched_for_kommune(raw, files(spark, sf_dir), "Nowhere") == (None, None)
    done = raw.select("source").where(F.col("source").contains("NATION_3_"))
    pending = pending_sources(files(spark, sf_dir), done)
    assert pending.where(F.col("source") == "kartverket:1003_NATION_3_Properties.xlsx").count() == 0
    assert pending.where(F.col("source").contains("1004_NATION_4_")).count() == 1


def test_for_kommune_prunes_by_key(spark, sf_dir):
    from muniprop.operators import reports as R

    props = fx.fx_props(spark, sf_dir)
    one = R.for_kommune(props, "NATION 3 Kommune")
    assert one.count() == R.with_key(props).where(F.col("kommune_key") == "nation 3").count() > 0


def test_reports_run_on_pipeline_output(spark, sf_dir, tmp_path):
    from muniprop.plans import package as P
    from muniprop.sources import properties as SP

    raw = fx.fx_raw(spark, sf_dir)
    out = str(tmp_path / "properties")
    SP.write_properties(SP.build_properties(raw), out)
    props = spark.read.parquet(out)
    pkg = P.flatten_package(P.underwriting_package(props)).collect()
    assert len(pkg) == raw.select("kommune_name").distinct().count()
    assert all(r["score_percent"] is not None for r in pkg)
    files = spark.read.parquet(out).inputFiles()
    assert len(files) <= 4 * len(pkg)


def test_list_files_reads_names_only(spark, tmp_path):
    from muniprop.sources.manifest import list_files, manifest

    for name in ["1001_Oslo_Properties.xlsx", "~$1001_Oslo_Properties.xlsx", "1002_Bergen_Properties_Imputed.xlsx", "notes.txt"]:
        (tmp_path / name).write_bytes(b"x" * 10)
    m = manifest(list_files(spark, str(tmp_path)))
    got = {(r["kommune_name"], r["variant"]) for r in m.collect()}
    assert got == {("Oslo", "raw"), ("Bergen", "imputed")}


def test_shares_sum_to_hundred(spark, sf_dir):
    from muniprop.operators import reports as R

    props = fx.fx_props(spark, sf_dir)
    d = R.occupancy_distribution(props, 500).groupBy("kommune_key").agg(F.sum("share_percent").alias("s"), F.count("*").alias("n"))
    for r in d.collect():
        assert abs(r["s"] - 100.0) <= 0.005 * r["n"] + 1e-9


def test_scan_csv_sources(spark, sf_dir, tmp_path):
    from muniprop.sources import properties as SP

    raw = fx.fx_raw(spark, sf_dir)
    picked = [r["source"] for r in raw.select("source").distinct().orderBy("source").limit(2).collect()]
    for src in picked:
        name = src.split(":", 1)[1].replace(".xlsx", ".csv")
        raw.where(F.col("source") == src).drop("source", "row_no").coalesce(1).write.option("header", "true").csv(str(tmp_path / "tmp" / name))
        part = next((tmp_path / "tmp" / name).glob("part-*.csv"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(part.read_bytes())
    scanned = SP.scan_sources(spark, str(tmp_path / "in"), "csv")
    assert scanned.count() == raw.where(F.col("source").isin(picked)).count()
    assert {r["source"] for r in scanned.select("source").distinct().collect()} == {s.replace(".xlsx", ".csv") for s in picked}
    assert scanned.where(F.col("row_no").isNull()).count() == 0
    kept = ownership_filter(scanned).count()
    assert kept == ownership_filter(raw.where(F.col("source").isin(picked))).count()


def test_all_sources_at_once_equals_one_at_a_time(spark, sf_dir):
    cols = ["row_no", "source", "alt_adresser", "alt_adresser_fra_knr_gnr_bnr", "underenheter", "antall_underenheter", "tek_standard", "forenklet_bygningskategori"]
    raw = fx.fx_raw(spark, sf_dir)
    picked = [r["source"] for r in raw.select("source").distinct().orderBy("source").limit(3).collect()]
    sub = raw.where(F.col("source").isin(picked))
    together = {tuple(r) for r in PL.properties_rows(sub).select(*cols).collect()}
    separately = set()
    for s in picked:
        separately |= {tuple(r) for r in PL.properties_rows(sub.where(F.col("source") == s)).select(*cols).collect()}
    assert together == separately and len(together) > 0
