"""Exact duplicates: cheap blocks first, full hashes only inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import fold_case
from shelfmark.plans.skew import lookup_join


def _eligible(files: DataFrame) -> DataFrame:
    rows = files
    if "status" in files.columns:
        rows = rows.filter(F.col("status") != "Missing")
    if "is_directory" in files.columns:
        rows = rows.filter(~F.col("is_directory"))
    return rows


def quick_hash_collisions(files: DataFrame) -> DataFrame:
    """Files that share quick hash and size with another one; adds ``block_size``."""
    rows = _eligible(files)
    blocks = (rows.filter(F.col("quick_hash").isNotNull()).groupBy("quick_hash", "size")
              .agg(F.count("*").alias("block_size")).filter("block_size > 1"))
    return lookup_join(rows, blocks, ["quick_hash", "size"], "block_size", "inner", salt_on=["file_key"])


def exact_duplicates(files: DataFrame) -> DataFrame:
    """Rows whose SHA-256 occurs more than once; adds ``copies``.

    Copies are counted per hash with map-side combine; the counts come back by a
    join that spreads hot hashes, so no task ever holds one hash's rows.
    """
    groups = (files.filter(F.col("sha256").isNotNull()).groupBy("sha256")
              .agg(F.count("*").alias("copies")).filter("copies > 1"))
    return lookup_join(files, groups, ["sha256"], "copies", "inner", salt_on=["file_key"])


def confirm_duplicates(collisions: DataFrame, full_hashes: DataFrame) -> DataFrame:
    """Collision rows joined to their full hashes, kept where the hash repeats.

    ``full_hashes``: file_key, sha256. Only colliding files need one.
    """
    hashed = collisions.drop("sha256").join(full_hashes.select("file_key", "sha256"), "file_key", "inner")
    return exact_duplicates(hashed)


def mark_duplicates(files: DataFrame, duplicate_keys: DataFrame) -> DataFrame:
    """Status becomes Duplicate for every listed file, Missing ones too."""
    marks = duplicate_keys.select("file_key").distinct().withColumn("__hit", F.lit(True))
    return (files.join(marks, "file_key", "left")
            .withColumn("status", F.when(F.col("__hit"), "Duplicate").otherwise(F.col("status")))
            .drop("__hit"))


def files_with_shared_hash(hashes: DataFrame) -> DataFrame:
    """File keys whose stored SHA-256 another file carries as well."""
    sha = hashes.filter(F.col("algorithm") == "SHA256").select("file_key", F.col("hash").alias("sha256"))
    return exact_duplicates(sha).select("file_key", "sha256", "copies")


def duplicate_report(files: DataFrame, games: DataFrame, hashes: DataFrame, systems: DataFrame) -> DataFrame:
    """Duplicate files of known games with their hash, in hash then path order."""
    sha = hashes.filter(F.col("algorithm") == "SHA256").select("file_key", F.col("hash").alias("sha256"))
    rows = (files.filter((F.col("status") == "Duplicate") & F.col("game_key").isNotNull())
            .select("file_key", "game_key", "file_name", "path", "size"))
    # Hashes are long and hardly compress, so they come last: one join fewer deals them out again.
    owned = (rows.join(games.select("game_key", "system_key", "title"), "game_key")
             .join(systems.select("system_key", "system_name"), "system_key"))
    return (owned.join(sha, "file_key")
            .select("sha256", F.col("system_name").alias("system"), F.col("title").alias("game_title"),
                    "file_name", "path", "size")
            .orderBy("sha256", fold_case(F.col("path")), "path"))


def duplicate_groups(report: DataFrame) -> DataFrame:
    """One row: duplicate rows, groups and the bytes freed by keeping one copy each."""
    groups = report.groupBy("sha256").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
                      F.count("*").alias("groups"),
                      F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).cast("long").alias("reclaimable"))
