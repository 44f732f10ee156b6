"""Reports and export manifests, and the versioned tables between jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import fold_case, sanitise_folder
from shelfmark.plans.skew import lookup_join

# Report headers.
INVENTORY_HEADER = ["System", "Game Title", "File Name", "Full Path", "Source Folder", "Format", "Size Bytes",
                    "Modified UTC", "Region", "Language", "Revision", "Version", "Status", "Catalog Status",
                    "Catalog Source", "Catalog Name", "Preferred", "Manual Preference", "Excluded",
                    "Preference Score", "Quick Hash", "SHA-256", "SHA-1"]
DUPLICATE_HEADER = ["SHA-256", "System", "Game Title", "File Name", "Full Path", "Size Bytes"]


def _report_text(rows: DataFrame) -> DataFrame:
    """All columns as report text: null is empty, booleans read True/False."""
    def text(name: str, kind: str):
        column = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            # An instant prints in the session's zone, so it is moved to UTC; a time without zone stays as it is.
            utc = column if kind == "timestamp_ntz" else F.to_utc_timestamp(column, F.current_timezone())
            return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
        if kind == "boolean":
            return F.initcap(column.cast("string"))
        return column.cast("string")
    return rows.select(*[F.coalesce(text(name, kind), F.lit("")).alias(name) for name, kind in rows.dtypes])


def _write_csv(rows: DataFrame, path: str, compression: str) -> None:
    (_report_text(rows).write.mode("errorifexists")
     .option("header", "true").option("quoteAll", "true").option("escape", '"').option("emptyValue", "")
     .option("encoding", "UTF-8").option("compression", compression).csv(path))


def write_inventory_csv(inventory: DataFrame, path: str, compression: str = "none") -> None:
    """The 23-column report, every value quoted. Spark writes no byte-order mark.

    Large reports take a ``compression`` such as gzip; ``read_report_csv`` tells it from the files' names.
    """
    _write_csv(inventory.toDF(*INVENTORY_HEADER), path, compression)


def write_duplicate_csv(report: DataFrame, path: str, compression: str = "none") -> None:
    _write_csv(report.select("sha256", "system", "game_title", "file_name", "path", "size").toDF(*DUPLICATE_HEADER), path, compression)


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a written report back, all values as text."""
    return (spark.read.option("header", "true").option("quote", '"').option("escape", '"')
            .option("multiLine", "true").csv(path))


def export_manifest(export_files: DataFrame, destination: DataFrame) -> DataFrame:
    """What an export would do: target path, ``skip`` or ``copy``, and collisions.

    ``export_files``: system_name, path, file_name, is_directory, size;
    ``destination``: target, size (existing files). Two sources with one target
    are flagged, because the later one would overwrite the earlier.
    """
    rows = export_files.withColumn("target", F.concat_ws(
        "/", sanitise_folder(F.col("system_name")), "file_name")).withColumn("target_key", fold_case(F.col("target")))
    sharing = rows.groupBy("target_key").agg(F.count("*").alias("sources"))
    existing = destination.groupBy("target").agg(F.max("size").alias("existing_size"))
    return (lookup_join(rows, sharing, ["target_key"], "sources", "inner", salt_on=["path"]).join(existing, "target", "left")
            .withColumn("action", F.when(F.col("existing_size") == F.col("size"), "skip").otherwise("copy"))
            .withColumn("collides", F.col("sources") > 1)
            .select("system_name", "path", "target", "is_directory", "size", "action", "collides"))


def export_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(F.col("action") == "copy").alias("copied"),
                        F.count_if(F.col("action") == "skip").alias("skipped"),
                        F.count_if("collides").alias("collisions"))


def write_export(contents: DataFrame, path: str) -> None:
    """Preferred contents as a table partitioned by system folder.

    ``contents``: system_name, target, content. Rows of one system are not
    gathered: every task writes its own part of each folder.
    """
    (contents.withColumn("system", sanitise_folder(F.col("system_name"))).drop("system_name")
     .write.mode("errorifexists").partitionBy("system").parquet(path))


def write_version(table: DataFrame, base: str, version: int) -> None:
    """Write one version of a table. Writing the same version again replaces it."""
    table.write.mode("overwrite").parquet(f"{base.rstrip('/')}/version={version:012d}")


def read_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/version={version:012d}")
