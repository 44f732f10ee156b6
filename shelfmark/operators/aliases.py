"""What became of merged games: a table that later runs look through, so a merged title's file finds the game that was kept.

The table is a union-find forest kept flat: each merged key points straight at its root, and no root is a key. Each batch
of merges keeps it so with one join, so a lookup is one join as well, whatever the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.skew import lookup_join


def empty_aliases(games: DataFrame) -> DataFrame:
    """(game_key, root_key) without rows, with the key type of ``games``."""
    return games.select("game_key", F.col("game_key").alias("root_key")).filter(F.lit(False))


def record_merges(aliases: DataFrame, decisions: DataFrame) -> DataFrame:
    """The next version of the table. ``decisions``: game_key, keep_key, as ``merge_decisions`` settles them.

    Keys that pointed at a game merged now point at the one it went to. A game that is kept is a root
    again even if its key was merged before: it exists, so what was said of it no longer holds.
    """
    decided = decisions.select("game_key", "keep_key").filter("game_key <> keep_key")
    # A key counts as decided anew whether it goes or stays.
    named = decided.select("game_key").unionByName(decided.select(F.col("keep_key").alias("game_key"))).distinct()
    older = aliases.join(named, "game_key", "left_anti")
    weights = older.groupBy("root_key").agg(F.count("*").alias("members"))
    moved = (decided.select(F.col("game_key").alias("root_key"), "keep_key").join(weights, "root_key"))
    followed = lookup_join(older, moved, ["root_key"], "members", "left", salt_on=["game_key"])
    return (followed.select("game_key", F.coalesce("keep_key", "root_key").alias("root_key"))
            .unionByName(decided.select("game_key", F.col("keep_key").alias("root_key"))))


def forget_merges(aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the given keys: their files found a game of their own again. ``keys``: game_key."""
    return aliases.join(keys.select("game_key"), "game_key", "left_anti")


def follow_aliases(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """``files`` with the game that each one's key stands for now. One key may name any share of the files."""
    used = files.filter(F.col("game_key").isNotNull()).groupBy("game_key").agg(F.count("*").alias("members"))
    lookup = aliases.join(used, "game_key")
    found = lookup_join(files, lookup, ["game_key"], "members", "left", salt_on=[files.columns[0]])
    return found.withColumn("game_key", F.coalesce("root_key", "game_key")).select(files.columns)
