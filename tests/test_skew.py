"""Reports stay exact when one municipality holds about a third of all rows."""

from pyspark.sql import functions as F

from muniprop import fixtures as fx
from muniprop.operators import reports as R


def _skewed(spark, sf_dir):
    props = R.with_key(fx.fx_props(spark, sf_dir))
    hot = props.where(F.col("kommune_key") == "nation 3")
    extra = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn(
        "id", F.col("id") + F.col("copy") * 10_000_000
    ).drop("copy")
    return props.unionByName(extra)


def test_hot_municipality_top_k_and_shares(spark, sf_dir):
    props = _skewed(spark, sf_dir)
    pdf = props.select("kommune_key", "id", "adresse", "adressenavn", "bruksareal_totalt", "forenklet_bygningskategori").toPandas()
    total = len(pdf)
    hot_rows = (pdf["kommune_key"] == "nation 3").sum()
    assert hot_rows > total / 3

    pdf["area"] = pdf["bruksareal_totalt"].fillna(0.0)
    pdf["label"] = pdf["adresse"].fillna(pdf["adressenavn"]).fillna("-")
    want = (
        pdf.sort_values(["kommune_key", "area", "label", "id"], ascending=[True, False, True, True])
        .groupby("kommune_key")
        .head(10)
    )
    got = R.top_properties(props, 10).select("kommune_key", "rank", "address_label", "total_bruksareal").toPandas()
    assert len(got) == len(want)
    for key, g in want.groupby("kommune_key"):
        exp = list(zip(g["label"], g["area"]))
        act = got[got["kommune_key"] == key].sort_values("rank")
        assert list(zip(act["address_label"], act["total_bruksareal"])) == exp

    cat = pdf[pdf["forenklet_bygningskategori"].notna() & (pdf["forenklet_bygningskategori"].str.strip(" ") != "")]
    sums = cat.groupby(["kommune_key", "forenklet_bygningskategori"])["area"].agg(["sum", "count"]).reset_index()
    dist = R.occupancy_distribution(props, 500).toPandas()
    merged = dist.merge(sums, left_on=["kommune_key", "occupancy_category"], right_on=["kommune_key", "forenklet_bygningskategori"])
    assert len(merged) == len(sums) == len(dist)
    assert (merged["building_count"] == merged["count"]).all()
    assert (merged["total_bruksareal"] == merged["sum"]).all()
