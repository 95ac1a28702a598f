"""Incremental ingest: two arrivals of source files end up as the batch-built table."""

import tempfile

from pyspark.sql import functions as F

from muniprop import fixtures as fx
from muniprop.sources.properties import build_properties
from muniprop.streaming.ingest import start_ingest


def test_ingest_two_arrivals_equals_batch(spark, sf_dir):
    raw = fx.fx_raw(spark, sf_dir).drop("source")
    src, target = tempfile.mkdtemp(prefix="ingest-src-"), tempfile.mkdtemp(prefix="ingest-out-") + "/props"
    name = F.concat(F.lit("10"), F.lpad(F.col("kommunenummer").cast("string").substr(3, 2), 2, "0"))
    files = raw.withColumn("_f", name)
    keys = sorted(r["_f"] for r in files.select("_f").distinct().collect())
    first, second = keys[: len(keys) // 2], keys[len(keys) // 2:]
    for group in (first, second):
        for k in group:
            part = files.where(F.col("_f") == k).drop("_f")
            nation = part.select("kommune_name").first()["kommune_name"]
            part.coalesce(1).write.parquet(f"{src}/{k}_{nation}_Properties.parquet")
        q = start_ingest(spark, f"{src}/*", target, name="t-ingest")
        q.awaitTermination(120)
    stored = spark.read.parquet(target)
    assert stored.count() == build_properties(fx.fx_raw(spark, sf_dir)).count()
    assert stored.select("source").distinct().count() == len(keys)
    ids = stored.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()
    assert (ids[0], ids[1], ids[2]) == (0, stored.count() - 1, stored.count())
    labels = {r["kommune"] for r in stored.select("kommune").distinct().collect()}
    assert all(label.startswith("NATION ") and label.endswith(" Kommune") for label in labels)
