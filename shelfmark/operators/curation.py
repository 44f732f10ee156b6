"""Finding and applying title clean-ups, merges and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfmark import fixed_values as V
from shelfmark.functions.text import (fold_case, game_key, is_blank,
                                      sort_title, strip_any_number_prefix,
                                      strip_blanks, strip_rank_prefix,
                                      strip_trailing_tags)
from shelfmark.operators.fuzzy import fuzzy_title_pairs
from shelfmark.operators.preference import best_units, is_winner, with_old_score
from shelfmark.plans.components import connected_components
from shelfmark.plans.skew import broadcast_if_small, lookup_join
from shelfmark.session import shared_folder


def present_file_counts(files: DataFrame) -> DataFrame:
    """Non-missing files per game."""
    return (files.filter(F.col("game_key").isNotNull()).groupBy("game_key")
            .agg(F.count_if(F.col("status") != "Missing").alias("file_count")))


def _with_counts(games: DataFrame, files: DataFrame) -> DataFrame:
    return (games.join(present_file_counts(files), "game_key", "left")
            .withColumn("file_count", F.coalesce("file_count", F.lit(0).cast("long"))))


# --- fuzzy title pairs -----------------------------------------------------

def fuzzy_top(pairs: DataFrame, per_system: int = V.FUZZY_TOP, overall: int = V.FUZZY_TOP) -> DataFrame:
    """The report's best pairs: top per system, then top overall.

    The overall top can only hold pairs that are in their system's top, so with
    ``overall <= per_system`` one top-k is enough and no system is sorted whole.
    """
    order = [F.desc("similarity"), F.asc("system_key"), F.asc("id_a"), F.asc("id_b")]
    rows = pairs
    if overall > per_system:
        ranked = Window.partitionBy("system_key").orderBy(*order)
        rows = rows.withColumn("__rank", F.row_number().over(ranked)).filter(F.col("__rank") <= per_system).drop("__rank")
    return rows.orderBy(*order).limit(overall)


def fuzzy_candidates(games: DataFrame, files: DataFrame, systems: DataFrame, top: int | None = None) -> DataFrame:
    """The merge review list: pairs with titles, system name and file counts; all of them, or the best ``top``."""
    titles = games.select("system_key", F.col("game_key").alias("id"), "normalised_title")
    shared_folder(games.sparkSession)
    pairs = fuzzy_title_pairs(titles)
    # Stored once, read three times.
    listed = (pairs if top is None else fuzzy_top(pairs, top, top)).select("system_key", "id_a", "id_b", "similarity").checkpoint()
    ends = broadcast_if_small(listed.select(F.explode(F.array("id_a", "id_b")).alias("game_key")).distinct())
    counted = _with_counts(games.join(ends, "game_key", "left_semi"), files.join(ends, "game_key", "left_semi"))
    info = counted.select("game_key", "title", "file_count")
    a = info.select(F.col("game_key").alias("id_a"), F.col("title").alias("game_a"), F.col("file_count").alias("files_a"))
    b = info.select(F.col("game_key").alias("id_b"), F.col("title").alias("game_b"), F.col("file_count").alias("files_b"))
    return (listed.join(a, "id_a").join(b, "id_b").join(systems.select("system_key", "system_name"), "system_key")
            .select("id_a", "game_a", "id_b", "game_b", "system_name", "files_a", "files_b", "similarity")
            .orderBy(F.desc("similarity"), "id_a", "id_b"))


# --- exact title groups and merges -----------------------------------------

def exact_title_groups(games: DataFrame, files: DataFrame, systems: DataFrame) -> DataFrame:
    """System and title shared by several games: number of games and present files."""
    named = _with_counts(games, files).join(systems.select("system_key", "system_name"), "system_key")
    return (named.groupBy("system_name", "title")
            .agg(F.sum("file_count").alias("total_files"), F.count("*").alias("games"))
            .filter("games > 1"))


def exact_title_members(games: DataFrame, files: DataFrame, systems: DataFrame) -> DataFrame:
    """The groups in long form, one row per game, in report order.

    One row per member instead of one list per group: a group may be large.
    """
    named = games.select("game_key", "system_key", "title").join(
        systems.select("system_key", "system_name"), "system_key")
    groups = exact_title_groups(games, files, systems)
    return (lookup_join(named, groups, ["system_name", "title"], "games", "inner", salt_on=["game_key"])
            .select("system_name", "title", "total_files", "games", "game_key")
            .orderBy("system_name", fold_case(F.col("title")), "title", "game_key"))


def _survivor_order():
    return F.struct((-F.col("file_count")).alias("order"), F.col("game_key").alias("game_key"))


def merge_survivors(games: DataFrame, files: DataFrame) -> DataFrame:
    """Per exact-title group the game to keep: most present files, then lowest key."""
    counted = _with_counts(games, files)
    return (counted.groupBy("system_key", "title")
            .agg(F.min(_survivor_order()).alias("best"), F.count("*").alias("games"))
            .filter("games > 1")
            .select("system_key", "title", F.col("best.game_key").alias("keep_key"), "games"))


def exact_title_decisions(games: DataFrame, files: DataFrame) -> DataFrame:
    """(game_key, keep_key) for every game that an exact-title merge removes."""
    return (lookup_join(games.select("game_key", "system_key", "title"), merge_survivors(games, files),
                        ["system_key", "title"], "games", "inner", salt_on=["game_key"])
            .filter(F.col("game_key") != F.col("keep_key")).select("game_key", "keep_key"))


def merge_decisions(games: DataFrame, files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Turn merge pairs (keep, drop) of any shape into (game_key, keep_key).

    Chains and cycles collapse into components. A component keeps the game that
    is named ``keep`` and never ``drop``, as the user chose. Only where none or
    several are, the one with the most present files and then the lowest key stays
    (among the several). Unknown games are ignored.
    """
    known = games.select("game_key")
    usable = (pairs.filter(F.col("keep") != F.col("drop"))
              .join(known.withColumnRenamed("game_key", "keep"), "keep", "left_semi")
              .join(known.withColumnRenamed("game_key", "drop"), "drop", "left_semi"))
    members = connected_components(usable, "keep", "drop").withColumnRenamed("node", "game_key")
    dropped = usable.select(F.col("drop").alias("game_key")).distinct().withColumn("dropped", F.lit(True))
    counted = (members.join(present_file_counts(files), "game_key", "left").join(dropped, "game_key", "left")
               .withColumn("file_count", F.coalesce("file_count", F.lit(0).cast("long"))))
    order = F.struct(F.coalesce("dropped", F.lit(False)).alias("dropped"), (-F.col("file_count")).alias("order"),
                     F.col("game_key").alias("game_key"))
    best = (counted.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("members"))
            .select("root", F.col("best.game_key").alias("keep_key"), "members"))
    # Stored once: every step of a merge reads the decisions.
    return (lookup_join(members, best, ["root"], "members", "inner", salt_on=["game_key"])
            .filter(F.col("game_key") != F.col("keep_key"))
            .select("game_key", "keep_key").checkpoint())


def apply_merges(games: DataFrame, files: DataFrame, decisions: DataFrame,
                 elect: bool = True) -> tuple[DataFrame, DataFrame]:
    """Move files to the kept games, drop merged games, elect again where files moved.

    A moved file keeps its group, told apart by the game it came from, because
    groups move whole.
    """
    kept_games = games.join(decisions.select("game_key"), "game_key", "left_anti")
    new_group = F.when(F.col("file_group").isNotNull(), F.concat_ws("@", "file_group", F.col("game_key").cast("string")))

    def move(rows: DataFrame, is_moved) -> DataFrame:
        return (rows.withColumn("file_group", F.when(is_moved, new_group).otherwise(F.col("file_group")))
                .withColumn("game_key", F.coalesce("keep_key", "game_key")).drop("keep_key"))
    if not elect:
        return kept_games, move(files.join(decisions, "game_key", "left"), F.col("keep_key").isNotNull())
    # Where the files of every touched game go: of those that are kept, nowhere else.
    keepers = (decisions.select(F.col("keep_key").alias("game_key")).distinct()
               .join(decisions.select("game_key"), "game_key", "left_anti"))
    homes = (decisions.select("game_key", "keep_key", F.lit(True).alias("__moved"))
             .unionByName(keepers.select("game_key", F.col("game_key").alias("keep_key"), F.lit(False).alias("__moved"))))
    # A score does not depend on the game, so it is worked out before the files of touched games travel to their pick,
    # and all files meet once what was decided for their game.
    scored = with_old_score(files)
    winners = best_units(move(scored.join(homes, "game_key"), F.col("__moved"))).select(
        F.col("game_key").alias("keep_key"), F.col("unit_key").alias("__winner"))
    decided = homes.join(winners, "keep_key", "left")
    touched = F.col("__moved").isNotNull()
    joined = move(scored.join(decided, "game_key", "left"), F.col("__moved"))
    return kept_games, (joined.withColumn("is_preferred", F.when(touched, is_winner("__winner")).otherwise(F.col("is_preferred")))
                        .withColumn("preference_score", F.when(touched, F.col("preference_score")).otherwise(F.col("__old_score")))
                        .drop("__old_score", "__moved", "__winner"))


# --- title clean-up --------------------------------------------------------

def rank_prefix_convention(games: DataFrame, systems: DataFrame) -> DataFrame:
    """Per system name: how many titles lead with a number, and whether it is a habit."""
    named = games.join(systems.select("system_key", "system_name"), "system_key")
    hits = F.count_if(strip_any_number_prefix(F.col("title")).isNotNull())
    return named.groupBy("system_name").agg(
        hits.alias("prefixed"), F.count("*").alias("titles"),
        (hits >= V.RANK_PREFIX_MIN_TITLES).alias("widespread"))


def best_verified_name(files: DataFrame) -> DataFrame:
    """Per game the catalog name of a verified copy, the preferred one first."""
    named = files.filter((F.col("catalog_status") == "Verified") & F.col("catalog_name").isNotNull()
                         & F.col("game_key").isNotNull())
    order = F.struct((~F.col("is_preferred")).alias("other"), F.col("file_key").alias("file_key"))
    return named.groupBy("game_key").agg(F.min_by("catalog_name", order).alias("verified_name"))


def title_cleanup_candidates(games: DataFrame, files: DataFrame, systems: DataFrame) -> DataFrame:
    """Suggested titles with their reason, only where they differ from the current one."""
    habit = rank_prefix_convention(games, systems).select("system_name", "widespread")
    rows = (games.select("game_key", "system_key", "title")
            .join(systems.select("system_key", "system_name"), "system_key")
            .join(habit, "system_name")
            .join(best_verified_name(files), "game_key", "left"))
    verified = ~is_blank(F.col("verified_name"))
    numeric = F.when(F.col("widespread"), strip_any_number_prefix(F.col("title"))) \
               .otherwise(strip_rank_prefix(F.col("title")))
    base = F.when(verified, F.col("verified_name")).otherwise(numeric)
    rows = rows.withColumn("suggested_title", strip_blanks(strip_trailing_tags(base)))
    reason = F.when(verified, "Matches verified catalog name").otherwise("Removes numeric catalog-rank prefix")
    return (rows.withColumn("reason", reason)
            .filter((F.col("suggested_title") != "") & (F.col("suggested_title") != F.col("title")))
            .select("game_key", "system_name", F.col("title").alias("current_title"), "suggested_title", "reason")
            .orderBy("system_name", fold_case(F.col("current_title")), "game_key"))


def apply_title_cleanup(games: DataFrame, titles: DataFrame) -> DataFrame:
    """``titles``: game_key, new_title. The grouping key of a game never changes."""
    joined = games.join(titles.select("game_key", "new_title"), "game_key", "left")
    return (joined.withColumn("title", F.coalesce("new_title", "title"))
            .withColumn("sort_title", F.when(F.col("new_title").isNotNull(), sort_title(F.col("new_title")))
                        .otherwise(F.col("sort_title"))).drop("new_title"))


# --- manual system assignment and dimensions -------------------------------

def assignment_problems(files: DataFrame, assignments: DataFrame, formats: DataFrame) -> DataFrame:
    """Assignments that cannot be carried out, with the reason."""
    claims = formats.select(F.col("system_key").alias("target"), "extension").distinct().withColumn("ok", F.lit(True))
    known = formats.select(F.col("system_key").alias("target")).distinct().withColumn("known", F.lit(True))
    rows = (assignments.select("file_key", F.col("system_key").alias("target"))
            .join(files.select("file_key", "extension", "game_key", F.lit(True).alias("found")), "file_key", "left")
            .join(known, "target", "left").join(claims, ["target", "extension"], "left"))
    problem = (F.when(F.col("found").isNull(), "file not in the library")
               .when(F.col("known").isNull(), "system not found")
               .when(F.col("ok").isNull(), "system has no format for the extension")
               .when(F.col("game_key").isNull(), "file has no game"))
    return rows.withColumn("problem", problem).filter("problem is not null").select("file_key", "target", "problem")


def assign_system(games: DataFrame, files: DataFrame, assignments: DataFrame,
                  formats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move files to another system by hand: (games, files) after the change.

    ``assignments``: file_key, system_key; one row per file. Impossible ones are
    reported by ``assignment_problems`` and change nothing.
    """
    choice = (formats.groupBy(F.col("system_key").alias("target"), "extension")
              .agg(F.min(F.struct((-F.col("priority")).alias("order"), "format_position", "format_name",
                                  "system_name")).alias("pick"))
              .select("target", "extension", F.col("pick.format_name").alias("new_format"),
                      F.col("pick.system_name").alias("target_name")))
    owners = games.select("game_key", "title", "sort_title", "normalised_title", "is_wanted")
    moves = (files.filter(F.col("game_key").isNotNull()).select("file_key", "path", "extension", "game_key")
             .join(assignments.select("file_key", F.col("system_key").alias("target")), "file_key")
             .join(choice, ["target", "extension"]).join(owners, "game_key")
             .withColumn("new_game", game_key(F.col("target"), F.col("normalised_title"))))
    first = (moves.groupBy("new_game", "target")
             .agg(F.min_by(F.struct("title", "sort_title", "normalised_title", "is_wanted"),
                           F.struct(fold_case(F.col("path")), "path")).alias("origin")))
    added = (first.join(games.select(F.col("game_key").alias("new_game")), "new_game", "left_anti")
             .select(F.col("new_game").alias("game_key"), F.col("target").alias("system_key"), "origin.*"))
    new_games = games.unionByName(added.select(games.columns))
    plan = moves.select("file_key", "new_game", "new_format", F.col("target").alias("new_system"), "target_name")
    gaining = (plan.groupBy(F.col("new_game").alias("game_key"))
               .agg(F.count("*").alias("movers"), F.min("file_key").alias("sole")))
    moved = F.col("new_game").isNotNull()
    rows = files.join(plan, "file_key", "left")
    rows = (rows.withColumn("game_key", F.coalesce("new_game", "game_key"))
            .withColumn("format_name", F.coalesce("new_format", "format_name"))
            .withColumn("system_key", F.coalesce("new_system", "system_key"))
            .withColumn("confidence", F.when(moved, F.lit(1.0)).otherwise(F.col("confidence")))
            .withColumn("reason", F.when(moved, F.concat(F.lit("Manually assigned to "), F.col("target_name")))
                        .otherwise(F.col("reason")))
            .withColumn("is_detection_manual", F.when(moved, True).otherwise(F.col("is_detection_manual"))))
    # Every arrival clears the flag of the other files of its game; only a sole arrival keeps its own.
    rows = rows.join(gaining, "game_key", "left")
    lost = F.col("movers").isNotNull() & ((F.col("movers") > 1) | (F.col("sole") != F.col("file_key")))
    rows = rows.withColumn("is_preferred", F.when(lost, False).otherwise(F.col("is_preferred")))
    return new_games, rows.drop("new_game", "new_format", "new_system", "target_name", "movers", "sole")


def sync_systems(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert systems by key. Nothing is deleted and ``enabled`` keeps its value."""
    a, b = current.alias("a"), incoming.alias("b")
    joined = a.join(b, F.col("a.system_key") == F.col("b.system_key"), "full_outer")
    return joined.select(
        F.coalesce("a.system_key", "b.system_key").alias("system_key"),
        *[F.when(F.col("b.system_key").isNotNull(), F.col(f"b.{name}")).otherwise(F.col(f"a.{name}")).alias(name)
          for name in ("system_name", "manufacturer", "category")],
        F.coalesce("a.enabled", "b.enabled").alias("enabled"))


def sync_formats(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert formats by (system, extension, format name). Nothing is deleted."""
    keys = ["system_key", "extension", "format_name"]
    values = ["format_type", "priority", "requires_header_check", "is_archive", "is_multi_file"]
    new = incoming.select(*keys, F.struct(*values).alias("__new"))
    old = current.select(*keys, F.struct(*values).alias("__old"))
    return (old.join(new, keys, "full_outer").withColumn("__row", F.coalesce("__new", "__old"))
            .select(*keys, "__row.*"))
