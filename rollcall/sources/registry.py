"""Sources and sinks: register files, entity JSON, exports, sitemap, GeoJSON, visit log, import counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import cell_key, located, not_null_island
from ..operators.listing import global_position

ENTITY = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "city", "postalCode", "currentWebsite")])


def read_registry(spark: SparkSession, path: str, encoding: str = "utf8", limit: int | None = None) -> DataFrame:
    """A ``;``-separated register file, plain or gzip, all columns as trimmed strings; short and long lines are kept (SRC-1).

    ``limit`` takes the first rows. A gzip file is one task, so its rows are dealt out at once; ``refused_lines`` of the result are those that don't fit the header.
    """
    charset = {"latin1": "ISO-8859-1", "utf8": "UTF-8"}.get(encoding, encoding)
    names = spark.read.option("encoding", charset).text(path).filter("trim(value) <> ''").first()
    head = [h.strip().strip('"').lstrip("﻿") for h in names[0].split(";")] if names else []
    shape = T.StructType([T.StructField(h, T.StringType()) for h in head] + [T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.csv(path, sep=";", header=True, schema=shape, encoding=charset, mode="PERMISSIVE", escape='"', columnNameOfCorruptRecord="_corrupt_record", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True, multiLine=False)
    if limit:
        return df.limit(limit)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def refused_lines(df: DataFrame) -> DataFrame:
    """(line) of the rows of a register file that have too few or too many fields, as they stand in the file."""
    return df.filter(F.col("_corrupt_record").isNotNull()).select(F.col("_corrupt_record").alias("line"))


def read_entities_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of entity objects (SRC-2)."""
    return spark.read.schema(ENTITY).json(path, multiLine=True)


def write_results_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def unmatched_lines(df: DataFrame) -> DataFrame:
    """One JSON line per row (SRC-3)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_unmatched(df: DataFrame, path: str) -> None:
    unmatched_lines(df).write.text(path)


def export_search_docs(df: DataFrame, path: str, batch: int = 20_000) -> None:
    """Documents by ascending id in files of at most ``batch`` rows (SRC-5)."""
    df.repartitionByRange("id").sortWithinPartitions("id").write.option("maxRecordsPerFile", batch).json(path)


def export_batches(df: DataFrame, batch: int = 20_000) -> DataFrame:
    """Batches of the export: (batch, first_id, last_id, n)."""
    at = global_position(df.select("id"), ["id"])
    return at.groupBy(F.floor(F.col("position") / batch).cast("long").alias("batch")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


def sitemap_rows(registry: DataFrame, localities: DataFrame, base_url: str, chunk: int = 20_000) -> DataFrame:
    """(loc, lastmod, changefreq, priority, chunk): all URL families with the number of the file each goes to (SRC-6)."""
    fixed = registry.sparkSession.createDataFrame([(p,) for p in ("/", "/map", "/about")], "path string")
    row = lambda df, loc, mod, freq, prio: df.select(F.concat(F.lit(base_url), loc).alias("loc"), mod.cast("long").alias("lastmod"), F.lit(freq).alias("changefreq"), F.lit(prio).alias("priority"))
    rows = row(fixed, F.col("path"), F.lit(None), "weekly", "1.0")
    rows = rows.unionByName(row(localities, F.concat(F.lit("/place/"), "department", F.lit("/"), "slug"), F.col("updated"), "weekly", "0.6"))
    rows = rows.unionByName(row(registry.filter("status = 'published'"), F.concat(F.lit("/org/"), F.col("id").cast("string")), F.col("updated_at"), "monthly", "0.5"))
    at = global_position(rows, ["priority", "loc"])
    return at.withColumn("chunk", F.floor(F.col("position") / chunk).cast("long")).drop("position")


def write_sitemap(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("chunk").json(path)


def to_geojson(df: DataFrame, cap: int = 20_000) -> DataFrame:
    """(id, feature): point features without null coordinates and the box around (0, 0), the first ``cap`` by id (SRC-7)."""
    f = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        F.struct("id", "name", F.col("category_id").alias("category"), "city", F.coalesce("geo_approx", F.lit(False)).alias("approx")).alias("properties"),
    )
    return df.filter(located() & not_null_island()).orderBy("id").limit(cap).select("id", F.to_json(f).alias("feature"))


def write_by_cell(df: DataFrame, path: str, files: int | None = None, row_group: int = 16 << 20) -> None:
    """The table with its points' keys as ``cell``, dealt and sorted along the curve: a file, and a row group in it, hold points of one area, and a box reads few of them."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("cell", cell_key())
    keyed.repartitionByRange(n, "cell").sortWithinPartitions("cell").write.option("parquet.block.size", row_group).parquet(path)


def visits(stream: DataFrame) -> DataFrame:
    """Rows of the visit log: path of 120 characters, department of 3 at most."""
    return stream.select("ts", "kind", F.substring("path", 1, 120).alias("path"), F.substring("dept", 1, 3).alias("dept"), "visitor")


def append_visits(stream: DataFrame, path: str, checkpoint: str):
    """Appends the visit log, exactly once by checkpoint (SRC-8)."""
    return visits(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def import_metrics(df: DataFrame, skipped: Column, placed: Column, name: str = "import") -> tuple[DataFrame, Observation]:
    """``df`` with counters of rows read, skipped and placed, filled by whatever action comes next (SRC-9)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(skipped).alias("skipped"), F.count_if(placed).alias("placed")), seen


def public_record(df: DataFrame) -> DataFrame:
    """The served record: links with the site column before the map's own, approximate flag strict (PRJ-15)."""
    own = F.when(F.nullif(F.coalesce("website", F.lit("")), F.lit("")).isNotNull(), F.create_map(F.lit("website"), F.col("website")))
    from ..operators.merge import merge_maps

    return df.withColumns({"links": merge_maps(F.col("social"), own), "geo_approx": F.coalesce(F.col("geo_approx"), F.lit(False))})
