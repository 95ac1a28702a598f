"""Incremental ingest of newly arriving source files with Structured Streaming.

The batch loader rebuilds ``properties`` from every source; the source system also skips
sources it has already processed. Here the file source's own log plays that role: each new
source file is read exactly once and run through the same pipeline. A file is never split
across micro-batches, so the per-source steps (address backfill, sub-unit merge) see whole
sources.

Every micro-batch owns one folder of the table (``batch=N``) and overwrites it, so a batch that
is retried is stored once; its ids continue after the rows of the batches before it. Progress
lives under the shared ``spark.checkpoint.dir``, apart for every target.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muniprop.session import scratch_path
from muniprop.sources.export import stored
from muniprop.sources.manifest import strict_kommune_name
from muniprop.sources.properties import SOURCE_PREFIX, build_properties
from muniprop.sources.sheet_columns import conform_sheet


def _store_batch(target: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = stored(spark, target)  # None before the first batch
        first = 0 if before is None else before.where(F.col("batch") < batch_id).count()
        order = Window.partitionBy("source").orderBy("_path", "_at")
        rows = batch.withColumn("_at", F.monotonically_increasing_id())
        own = {c.lower(): c for c in rows.columns}
        no = F.col(own["row_no"]).cast("bigint") if "row_no" in own else F.lit(None).cast("bigint")
        name = F.col(own["kommune_name"]).cast("string") if "kommune_name" in own else F.lit(None).cast("string")
        strict = strict_kommune_name(F.regexp_replace("source", "^" + SOURCE_PREFIX, ""))
        rows = rows.withColumns({"_no": F.coalesce(no, F.row_number().over(order).cast("bigint") - 1), "_name": F.coalesce(name, strict)})
        sheet = conform_sheet(rows.drop("row_no", "kommune_name", "_path", "_at"), ("_no", "_name", "source"))
        sheet = sheet.withColumnsRenamed({"_no": "row_no", "_name": "kommune_name"})
        props = build_properties(sheet, first_id=first)
        props.hint("rebalance", "kommune_key").write.mode("overwrite").partitionBy("kommune_key").parquet(f"{target}/batch={batch_id}")

    return run


def start_ingest(
    spark: SparkSession,
    source_dir: str,
    target: str,
    name: str = "properties-ingest",
    files_per_batch: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start (or resume) the ingest; ``available_now`` processes what is there and stops. The
    columns are those of the sheets present at the start (parquet; schemas must merge)."""
    schema = spark.read.option("mergeSchema", "true").parquet(source_dir).schema
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = F.col("_metadata.file_path")
    # The sheet name, also when a sheet was written as a folder of part files.
    sheet = F.regexp_extract(path, r"([^/]*_Properties[^/]*)(/[^/]*)?$", 1)
    file_name = F.coalesce(F.nullif(sheet, F.lit("")), F.regexp_extract(path, r"([^/]*)$", 1))
    rows = reader.load(source_dir).withColumns({"source": F.concat(F.lit(SOURCE_PREFIX), file_name), "_path": path})
    progress = f"stream-{name}-{hashlib.sha256(target.encode()).hexdigest()[:16]}"
    writer = (
        rows.writeStream.queryName(name)
        .option("checkpointLocation", scratch_path(spark, progress))
        .foreachBatch(_store_batch(target))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
