"""The ``properties`` table (S01, S08-S10, S13): scan sources, build, number, report, store.

Rows are stored as parquet partitioned by ``kommune_key`` so that a per-municipality
report prunes to one folder, and every report's ``groupBy(kommune_key)`` starts from a
layout that already separates municipalities.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muniprop.functions.scalars import kommune_key
from muniprop.operators.enrich import ALT_KEY, render_addresses
from muniprop.plans.pipeline import properties_parts, properties_rows
from muniprop.session import ensure_checkpoint_dir, materialize
from muniprop.sources.manifest import SOURCE_PREFIX, sheet_name, source_label, strict_kommune_name
from muniprop.sources.sheet_columns import SHEET_HEADERS, conform_sheet, read_cells, stack_sheets
from muniprop.sources.sheets import read_sheets

# Columns every report reads; absent ones are added as typed nulls.
REPORT_COLUMNS = {
    "forenklet_bygningskategori": "string",
    "bygningsstatus": "string",
    "tek_standard": "string",
    "bruksareal_totalt": "double",
    "adresse": "string",
    "adressenavn": "string",
    "lat": "double",
    "lon": "double",
    "vannforsynings_kode_id": "int",
    "avlops_kode_id": "int",
    "oppvarmings_kode_ids": "string",
    "energikilde_kode_ids": "string",
    "har_sefrakminne": "int",
    "har_kulturminne": "int",
    "skjermingsverdig": "int",
    "antall_underenheter": "int",
    "antall_eiere": "int",
    "underenheter": "string",
}

BLOCK = 250_000  # row numbers of a source that are written and numbered together


def _merged_parquet(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Parquet sheets in one frame, as Spark reads them; None if their schemas do not merge."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(*paths)
    except (PySparkException, Py4JJavaError) as error:
        if "MERGE" not in str(error):
            raise
        return None


def scan_sources(spark: SparkSession, paths: list[str] | str, fmt: str = "parquet", sheet_folder: bool = False, delimiter: str = ",") -> DataFrame:
    """Building-ownership rows of many sheets, whatever their headers' order and spelling.

    Columns are found by name (the sheet's header or the library's own name) and read as text
    first, so ``301.0`` is a number and ``12B`` a house number; cells may hold line breaks, quotes
    and separators. ``source`` is the sheet's name: that of the file, or of its folder
    (``sheet_folder``, also ``sheet=NAME``) where a sheet is a folder of part files. ``kommune_name``
    comes from the sheet's name unless a column has it; ``row_no`` from a column, else it numbers
    the rows of a source by (part file, row). Columns the library does not know are in the map
    ``extra`` (of Parquet sheets with one schema: columns of their own). A sheet without a required
    column is an error when its rows are read.
    """
    many = [paths] if isinstance(paths, str) else list(paths)
    same = _merged_parquet(spark, many) if fmt == "parquet" else None
    if same is None:
        rows = read_sheets(spark, many, fmt, delimiter).withColumnsRenamed({"path": "_path", "at": "_at"})
        rows = read_cells(rows, list(SHEET_HEADERS)).withColumn("_no", F.col("row_no").cast("bigint")).withColumnRenamed("kommune_name", "_name").drop("row_no")
    else:
        rows = same.withColumns({"_path": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
        own = {c.lower(): c for c in same.columns}
        name = F.col(own["kommune_name"]).cast("string") if "kommune_name" in own else F.lit(None).cast("string")
        no = F.col(own["row_no"]).cast("bigint") if "row_no" in own else F.lit(None).cast("bigint")
        rows = rows.withColumns({"_no": no, "_name": name}).drop(*[own[c] for c in ("row_no", "kommune_name") if c in own])
        rows = stack_sheets([conform_sheet(rows, ("_path", "_at", "_no", "_name"))])
    rows = rows.withColumn("source", F.concat(F.lit(SOURCE_PREFIX), sheet_name(F.col("_path"), sheet_folder)))
    if sheet_folder:
        rows = _numbered_over_files(rows)
    strict = strict_kommune_name(F.regexp_replace("source", "^" + SOURCE_PREFIX, ""))
    return rows.select(
        F.coalesce("_no", "_at").alias("row_no"), "source", F.coalesce("_name", strict).alias("kommune_name"),
        *[F.col(f"`{c}`") for c in rows.columns if c not in ("source", "_path", "_at", "_no", "_name")],
    )


def _numbered_over_files(rows: DataFrame) -> DataFrame:
    """``_at`` counted on over the part files of a source, where rows have no number of their own: the
    rows are stored, counted per file, and each file starts after the rows of those before it."""
    rows = materialize(rows, "scanned")
    counts = rows.where("_no is null").groupBy("source", "_path").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = counts.select("source", "_path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, ["source", "_path"], "left").withColumn("_at", F.col("_at") + F.coalesce("_start", F.lit(0))).drop("_start")


def conform(df: DataFrame) -> DataFrame:
    """Add every report column that is absent as a typed null (schema union)."""
    missing = {c: F.lit(None).cast(t) for c, t in REPORT_COLUMNS.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def build_properties(raw: DataFrame, with_id: bool = True, first_id: int = 0) -> DataFrame:
    """Dedup rows of the filtered path, labelled with kommune and source, conformed,
    with the dense ``id`` in load order from ``first_id``. Rows that are to be stored need none: the
    stored table gives it (S09, ``load_properties``, ``read_properties``)."""
    rows = _labelled(properties_rows(raw))
    return with_dense_id(rows, start=first_id) if with_id else rows


def build_parts(raw: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """S08 as it is stored: the rows, with the key of their known addresses, and those once per key."""
    rows, known = properties_parts(raw)
    return _labelled(rows), known


def _labelled(rows: DataFrame) -> DataFrame:
    rows = rows.drop("parsed_underenheter").withColumn("kommune", source_label(F.col("source")))
    return conform(rows).withColumn("kommune_key", kommune_key("kommune"))


def with_dense_id(
    df: DataFrame, order: tuple[str, ...] = ("source", "row_no"), partitions: int | None = None, start: int = 0
) -> DataFrame:
    """Zero-based dense ``id`` in an order, for any frame, without a one-partition window.

    Range-partition and sort by the load order, checkpoint (lineage cut, stable partition
    contents), count rows per partition (one small row per partition), prefix-sum those counts
    and add each row's position inside its partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # Without an explicit count AQE may coalesce adjacent ranges, which keeps the global order;
    # a hot source is still split, because range bounds are sampled on (source, row_no).
    ranged = (
        (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order))
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged, "dense-id")  # fixes partition contents for both uses below
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("_pid", "_off")  # one row per partition: bounded by the partition count
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    out = ranged.join(F.broadcast(offsets), "_pid").withColumn("id", (F.lit(start) + F.col("_off") + local).cast("bigint"))
    return out.select("id", *[c for c in df.columns if c != "id"])


def load_report(data: DataFrame, dedup: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Per source rows loaded, duplicates removed, addresses backfilled; plus a total row.

    ``sources`` (column source) lists every source of the load, so that one without a loaded row
    is reported too; without it the sources of ``data`` are taken.
    """
    names = (data if sources is None else sources).select("source").distinct()
    before = data.groupBy("source").agg(F.count(F.lit(1)).alias("_before"))
    after = dedup.groupBy("source").agg(
        F.count(F.lit(1)).alias("_loaded"),
        F.count(F.when(F.col("alt_adresser_fra_knr_gnr_bnr"), F.lit(1))).alias("_filled"),
    )
    per = names.join(before, "source", "left").join(after, "source", "left").na.fill(0, ["_before", "_loaded", "_filled"])
    return per.rollup("source").agg(
        F.sum("_loaded").alias("rows_loaded"),
        F.sum(F.col("_before") - F.col("_loaded")).alias("duplicates_removed"),
        F.sum("_filled").alias("alt_address_backfilled"),
    )


def row_block() -> F.Column:
    return F.floor(F.col("row_no") / BLOCK).cast("bigint")


def write_properties(props: DataFrame, path: str) -> None:
    """S08 sink: full rebuild, partitioned by municipality, sorted by (source, row_no) in each file.

    One shuffle by (municipality, source, block of ``BLOCK`` row numbers): a group has at most
    ``BLOCK`` rows, so a hot municipality or source is spread over as many writers as it needs, and
    every block lies in one file, in order. No sampling, so the plan above runs once.
    """
    block = F.col("_block")
    rows = props.withColumn("_block", row_block()).repartition("kommune_key", "source", block)
    rows.sortWithinPartitions("kommune_key", "source", "row_no").drop("_block").write.mode("overwrite").partitionBy("kommune_key").parquet(path)


def load_properties(raw: DataFrame, path: str) -> None:
    """The ``properties`` table of all sources of ``raw``, built and stored. The known addresses
    that rows of a cadastre key share are stored once per key beside it (``addresses_path``):
    ``read_properties`` gives every row its whole ``alt_adresser``; the folder itself holds the row's
    own ones and the key ``ALT_KEY``."""
    rows, known = build_parts(raw)
    write_properties(rows, path)
    if known is not None:
        known.write.mode("overwrite").parquet(addresses_path(path))


def addresses_path(path: str) -> str:
    return f"{path.rstrip('/')}-addresses"


def with_stored_ids(stored: DataFrame, start: int = 0) -> DataFrame:
    """The rows of a table that ``write_properties`` wrote, with the dense ``id`` in load order
    (source, row_no): the rows before a block (a running sum of one small row per block) plus the
    place in the file where the block's row lies."""
    rows = stored.withColumns({"_at": F.col("_metadata.row_index"), "_block": row_block()})
    blocks = rows.groupBy("source", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("source", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("source").alias("_s"), F.col("_block").alias("_b"), (F.lit(start) + F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off")
    )
    out = rows.join(blocks, rows["source"].eqNullSafe(blocks["_s"]) & rows["_block"].eqNullSafe(blocks["_b"]))
    return out.select((F.col("_off") + F.col("_at")).alias("id"), *[c for c in stored.columns if c != "id"])


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with its ids. (Reports that need none, nor the alternate addresses, read the
    path itself.)"""
    rows = with_stored_ids(spark.read.parquet(path))
    return render_addresses(rows, spark.read.parquet(addresses_path(path))) if ALT_KEY in rows.columns else rows
