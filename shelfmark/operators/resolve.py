"""From identified files to game entities and multi-file units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import (fold_case, game_key, normalise_title,
                                      sort_title, with_parsed_name)


def parse_titles(files: DataFrame, name_column: str = "file_name") -> DataFrame:
    """Adds title, normalised title, game key and the parsed name parts.

    A folder package may bring ``package_title`` from its metadata; it then
    takes the place of the file name.
    """
    source = F.col(name_column)
    if "package_title" in files.columns:
        source = F.coalesce("package_title", source)
    parsed = with_parsed_name(files, source)
    return (parsed
            .withColumn("title", F.col("parsed.title"))
            .withColumn("normalised_title", normalise_title(F.col("title")))
            .withColumn("game_key", game_key(F.col("system_key"), F.col("normalised_title")))
            .withColumn("region", F.array_join("parsed.regions", ", "))
            .withColumn("language", F.array_join("parsed.languages", ", "))
            .withColumn("revision", F.col("parsed.revision"))
            .withColumn("version", F.col("parsed.version"))
            .withColumn("disc_number", F.col("parsed.disc_number"))
            .withColumn("track_number", F.col("parsed.track_number"))
            .withColumn("tags", F.col("parsed.tags"))
            .drop("parsed"))


def resolve_games(games: DataFrame, files: DataFrame) -> DataFrame:
    """Games after this scan: the known ones plus one per new key.

    The title of a new game is that of its first path. Files are reduced to one
    row per key with map-side combine before anything is joined.
    """
    order = F.struct(fold_case(F.col("path")), F.col("path"))
    # Files that follow a merge bring titles of their own: still one game per key.
    found = (files.filter(F.col("game_key").isNotNull()).groupBy("game_key")
             .agg(F.min_by(F.struct("system_key", "normalised_title", "title"), order).alias("first")).select("game_key", "first.*"))
    fresh = found.join(games.select("game_key"), "game_key", "left_anti")
    added = fresh.select("game_key", "system_key", "title", sort_title(F.col("title")).alias("sort_title"),
                         "normalised_title", F.lit(False).alias("is_wanted"))
    return games.select(added.columns).unionByName(added)


def resolve_file_group(files: DataFrame) -> DataFrame:
    """Adds ``file_group``: the disc or title a multi-file part belongs to, else null."""
    is_part = (F.coalesce("is_multi_file", F.lit(False)) | F.col("track_number").isNotNull()
               | ((F.lower("extension") == ".bin") & (F.col("format_type") == "DiscImage")))
    label = F.when(F.col("disc_number").isNotNull(),
                   F.concat(F.lit("Disc "), F.col("disc_number").cast("string"))).otherwise(F.col("title"))
    disc = F.coalesce(F.col("disc_number").cast("string"), F.lit("-"))
    return files.withColumn("file_group", F.when(is_part, F.concat_ws("|", disc, label)))
