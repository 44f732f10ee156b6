"""A whole scan: from a fresh listing to the next version of the library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import aliases, duplicates, identify, preference, reconcile, resolve
from shelfmark.session import shared_folder
from shelfmark.sources import listing as files_on_disk


@dataclass(frozen=True)
class Library:
    """The three tables a scan reads and replaces, and what became of merged games, which it only reads."""
    files: DataFrame
    games: DataFrame
    hashes: DataFrame
    merged: DataFrame | None = None


_KINDS = {"size": "long", "created": "timestamp", "modified": "timestamp", "disc_number": "int", "track_number": "int",
          "is_directory": "boolean", "confidence": "double", "catalog_verified_at": "timestamp", "is_preferred": "boolean",
          "is_manual": "boolean", "is_excluded": "boolean", "preference_score": "int", "is_detection_manual": "boolean",
          "last_seen": "timestamp"}


def empty_library(spark: SparkSession) -> Library:
    """What the first scan starts from."""
    files = spark.createDataFrame([], ", ".join(f"{name} {_KINDS.get(name, 'string')}" for name in reconcile.FILE_COLUMNS))
    games = spark.createDataFrame([], "game_key string, system_key string, title string, sort_title string, "
                                      "normalised_title string, is_wanted boolean")
    hashes = spark.createDataFrame([], "file_key string, algorithm string, hash string")
    return Library(files, games, hashes, aliases.empty_aliases(games))


def identify_listing(rows: DataFrame, formats: DataFrame, entries: DataFrame | None,
                     titles: DataFrame | None) -> DataFrame:
    """Changed listing rows → platform, parsed title, game key and multi-file unit."""
    found = (identify.identify_with_archives(rows, entries, formats) if entries is not None
             else identify.identify_format(rows, formats))
    if titles is not None:
        found = found.join(titles, "marker_path", "left")
    return resolve.resolve_file_group(resolve.parse_titles(found.filter(F.col("system_key").isNotNull())))


def scan(library: Library, listing: DataFrame, formats: DataFrame, runs: DataFrame,
         entries: DataFrame | None = None, titles: DataFrame | None = None,
         failures: DataFrame | None = None) -> tuple[Library, DataFrame]:
    """The next library and the run's difference table.

    ``listing``: rows of ``collapse_packages``; ``runs``: location, started,
    complete; ``entries``: archive members; ``titles``: marker_path,
    package_title; ``failures``: path of files that could not be read.

    Content is touched late and little: only new or changed supported files are
    sampled, and only files whose samples collide are read whole. A file that
    cannot be read counts as failed and changes nothing but its last-seen time.
    """
    shared_folder(listing.sparkSession)
    diff = reconcile.diff_listing(library.files, listing)
    fresh_keys = diff.filter(F.col("change").isin("added", "changed")).select("file_key")
    keyed = reconcile.with_file_key(listing)
    fresh = identify.supported_only(keyed.join(fresh_keys, "file_key", "left_semi"), formats)
    if failures is not None:
        fresh = fresh.join(failures.select("path"), "path", "left_anti")
    known = identify_listing(fresh, formats, entries, titles)
    if library.merged is not None:
        # A changed file of a merged title belongs to the game that was kept.
        known = aliases.follow_aliases(known, library.merged)
    known = known.checkpoint()

    plain = known.filter(~F.col("is_directory")).select("path", "size")
    sampled = files_on_disk.quick_hash_files(files_on_disk.spread_by_bytes(plain, F.lit(1 << 20))).select("path", "quick_hash")
    markers = known.filter("is_directory").select("path", F.col("marker_path"))
    marker_hashes = files_on_disk.sha256_files(markers.select(F.col("marker_path").alias("path")))
    package_hashes = (markers.join(marker_hashes.withColumnRenamed("path", "marker_path"), "marker_path")
                      .select("path", F.concat(F.lit("paramsfo:"), "sha256").alias("quick_hash")))
    hashed = known.join(sampled.unionByName(package_hashes), "path", "left").checkpoint()

    details = [name for name in reconcile.SCANNED if name not in keyed.columns] + ["file_group"]
    scanned = (keyed.drop("marker_path")
               .join(hashed.select("file_key", *details).withColumn("supported", F.lit(True)), "file_key", "left")
               .withColumn("supported", F.coalesce("supported", F.lit(False)))
               .withColumn("failed", F.col("supported") & F.col("quick_hash").isNull()))
    hashed = hashed.filter(F.col("quick_hash").isNotNull())
    files = reconcile.apply_scan(library.files, scanned, runs).checkpoint()
    games = resolve.resolve_games(library.games, hashed)

    kept = reconcile.drop_replaced_hashes(library.hashes, hashed)
    lacking = (duplicates.quick_hash_collisions(files)
               .join(kept.filter(F.col("algorithm") == "SHA256").select("file_key"), "file_key", "left_anti")).checkpoint()
    digests = files_on_disk.sha256_files(files_on_disk.spread_by_bytes(lacking).select("path")).filter(F.col("sha256").isNotNull())
    new_hashes = lacking.select("file_key", "path").join(digests, "path").select(
        "file_key", F.lit("SHA256").alias("algorithm"), F.col("sha256").alias("hash"))
    hashes = kept.select("file_key", "algorithm", "hash").unionByName(new_hashes).checkpoint()

    # Only hashes of this run can turn files into duplicates; older marks stay.
    newly = duplicates.files_with_shared_hash(hashes).join(
        hashes.join(hashed.select("file_key"), "file_key", "left_semi")
        .filter(F.col("algorithm") == "SHA256").select(F.col("hash").alias("sha256")).distinct(), "sha256", "left_semi")
    marked = duplicates.mark_duplicates(files, newly)
    return Library(preference.elect_preferred(marked), games, hashes, library.merged), diff


def supported_flags(listing: DataFrame, formats: DataFrame) -> DataFrame:
    """file_key, supported, failed for the run counters."""
    keyed = reconcile.with_file_key(listing).select("file_key", "extension")
    hits = identify.supported_only(keyed, formats).select("file_key", F.lit(True).alias("supported"))
    return (keyed.select("file_key").join(hits, "file_key", "left")
            .select("file_key", F.coalesce("supported", F.lit(False)).alias("supported"), F.lit(False).alias("failed")))
