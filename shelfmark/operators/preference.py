"""Which copy of a game is the one to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.packing import bits, in_bits, short_digest
from shelfmark.functions.scoring import preference_score
from shelfmark.functions.text import fold_case
from shelfmark.plans.skew import lookup_join


def _score(excluded: Column, manual: Column) -> Column:
    return preference_score(
        status=F.col("status"), catalog_status=F.col("catalog_status"), catalog_name=F.col("catalog_name"),
        file_name=F.col("file_name"), revision=F.col("revision"), extension=F.col("extension"),
        excluded=excluded, manual=manual)


def score_files(files: DataFrame) -> DataFrame:
    return files.withColumn("preference_score", _score(F.col("is_excluded"), F.col("is_manual")))


def _unit_key():
    return F.when(F.col("file_group").isNotNull(), F.concat(F.lit("G"), F.col("file_group"))) \
            .otherwise(F.concat(F.lit("F"), F.col("file_key")))


def preference_units(files: DataFrame) -> DataFrame:
    """One row per (game, unit): eligible, score, first path, number of files.

    A unit is a multi-file group or a single file. One excluded or missing
    member rules the whole unit out.
    """
    scored = score_files(files.filter(F.col("game_key").isNotNull())).withColumn("unit_key", _unit_key())
    return scored.groupBy("game_key", "unit_key").agg(
        F.bool_and(~F.col("is_excluded") & (F.col("status") != "Missing")).alias("eligible"),
        F.max("preference_score").alias("unit_score"),
        F.min(F.struct(fold_case(F.col("path")).alias("folded"), F.col("path").alias("path"))).alias("first"),
        F.count("*").alias("unit_files"))


def best_units(scored: DataFrame, there: Column | None = None) -> DataFrame:
    """(game_key, unit_key, game_files): the best eligible unit of each game, null where none is, and the game's number of files.

    ``scored``: files with their ``preference_score`` worked out; ``there``: whether a file is present, told by its status where not
    given. One pass: the
    single files of a game collapse to their best one while its multi-file
    groups are summed up, both with map-side combine. What reaches the pick per
    game is one row per group and one for all single files, so no game, however
    large, is ever sorted in one task.
    """
    eligible = ~F.col("is_excluded") & (F.col("status") != "Missing" if there is None else there)
    place = F.struct(fold_case(F.col("path")).alias("folded"), F.col("path").alias("path"))
    single = F.struct((-F.col("preference_score")).alias("order"), place.alias("first"),
                      F.concat(F.lit("F"), "file_key").alias("unit_key"))
    is_single = F.col("file_group").isNull()
    summed = scored.filter(F.col("game_key").isNotNull()).groupBy("game_key", "file_group").agg(
        F.min(F.when(is_single & eligible, single)).alias("single"),
        F.bool_and(eligible).alias("eligible"), F.max("preference_score").alias("score"),
        F.min(F.when(~is_single, place)).alias("first"), F.count("*").alias("n"))
    group = F.struct((-F.col("score")).alias("order"), F.col("first"), F.concat(F.lit("G"), "file_group").alias("unit_key"))
    choice = F.when(is_single, F.col("single")).when(F.col("eligible"), group)
    return (summed.groupBy("game_key").agg(F.min(choice).alias("best"), F.sum("n").alias("game_files"))
            .select("game_key", F.col("best.unit_key").alias("unit_key"), "game_files"))


def is_winner(winner: str) -> Column:
    """Whether a file belongs to the unit that the column names."""
    return F.coalesce(F.col(winner) == _unit_key(), F.lit(False))


def with_old_score(files: DataFrame) -> DataFrame:
    """Scored files that remember the score they had; what only the score reads is not carried any further."""
    old_score = F.col("preference_score") if "preference_score" in files.columns else F.lit(0)
    return score_files(files.withColumn("__old_score", old_score))


def elect_preferred(files: DataFrame) -> DataFrame:
    """Sets ``preference_score`` and ``is_preferred`` on every file that has a game; all others keep both values.

    The winners come back by game, in a join that spreads a hot one.
    """
    scored = with_old_score(files)
    winners = best_units(scored).withColumnRenamed("unit_key", "__winner")
    joined = lookup_join(scored, winners, ["game_key"], "game_files", salt_on=["file_key"])
    part = F.col("game_key").isNotNull()
    return (joined.withColumn("is_preferred", F.when(part, is_winner("__winner")).otherwise(F.col("is_preferred")))
            .withColumn("preference_score", F.when(part, F.col("preference_score")).otherwise(F.col("__old_score")))
            .drop("__old_score", "__winner", "game_files"))


def _elect_in_games(files: DataFrame, game_keys: DataFrame, scope: Column, changes: dict[str, Column]) -> DataFrame:
    """Where ``scope`` holds in the given games, set the columns of ``changes`` and elect again; other rows keep their values.

    The score a file would have is worked out before it is known whether its game is among them, so only keys,
    scores and flags travel: to the pick the files in scope of these games, and all files once, to what was decided for their game.
    """
    kept = {name: f"__kept_{name}" for name in changes}
    rows = files.withColumns({"__scope": F.col("game_key").isNotNull() & scope, **{kept[name]: F.col(name) for name in changes}})
    scored = with_old_score(rows.withColumns(changes))
    wanted = game_keys.select("game_key").distinct()
    winners = best_units(scored.filter("__scope").join(wanted, "game_key", "left_semi")).withColumnRenamed("unit_key", "__winner")
    decided = (wanted.join(winners, "game_key", "left").withColumn("__touched", F.lit(True))
               .withColumn("game_files", F.coalesce("game_files", F.lit(0).cast("long"))))
    part = F.coalesce("__touched", F.lit(False)) & F.col("__scope")
    joined = lookup_join(scored, decided, ["game_key"], "game_files", salt_on=["file_key"])
    return (joined.withColumns({"is_preferred": F.when(part, is_winner("__winner")).otherwise(F.col("is_preferred")),
                                "preference_score": F.when(part, F.col("preference_score")).otherwise(F.col("__old_score")),
                                **{name: F.when(part, F.col(name)).otherwise(F.col(kept[name])) for name in changes}})
            .drop("__scope", "__old_score", "__winner", "game_files", "__touched", *kept.values()))


# What a file says about itself where it meets its game: two bits for each flag (null, no, yes), and two scores in one number.
_FLAG_BITS = {"is_manual": 0, "is_excluded": 2, "is_preferred": 4, "__there": 6}
_SCORE_BITS = {"__by_hand": 0, "__plain": 16}
_LEAST_SCORE = -(1 << 15)


def _packed_flags() -> Column:
    packed = F.lit(0)
    for name, place in _FLAG_BITS.items():
        packed = packed + F.when(F.col(name), 2 << place).when(~F.col(name), 1 << place).otherwise(0)
    return packed


def _flag(name: str) -> Column:
    held = bits(F.col("__flags"), _FLAG_BITS[name], 2)
    return F.when(held > 0, held == 2)


def _named_rows(rows: DataFrame, overrides: DataFrame, key: Column) -> DataFrame:
    """Rows with the flags that the overrides give them; they meet by a digest of the file key."""
    by_digest = overrides.select(short_digest(F.col("file_key")).alias("__digest"), "manual", "excluded")
    named = F.col("manual").isNotNull()
    return rows.join(by_digest, short_digest(key) == F.col("__digest"), "left").withColumns({
        "is_preferred": F.when(named & F.col("excluded"), False).otherwise(F.col("is_preferred")),
        "is_excluded": F.when(named, F.col("excluded")).otherwise(F.col("is_excluded")),
        "is_manual": F.when(named & F.col("excluded"), False).when(named, F.col("manual")).otherwise(F.col("is_manual"))})


def set_copy_preference(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply manual choices and exclusions, then elect again in the touched games.

    ``overrides``: file_key, manual, excluded (one row per file). A manual choice
    clears the flags of its siblings; an exclusion clears its own. Where a batch
    names several manual files of one game, the one with the last key stays.

    All files meet the overrides once and their games once: the pick and the result take the same columns, so that
    one exchange serves both. What only a score reads does not travel, nor does a key that the path tells.
    """
    known = (files.select("file_key", "game_key")
             .join(overrides.select("file_key", "manual", "excluded"), "file_key"))
    chosen = (known.filter(F.col("game_key").isNotNull()).groupBy("game_key")
              .agg(F.max(F.when(F.col("manual"), F.col("file_key"))).alias("chosen")))
    # All scores a file may come to have, worked out before its flags are known.
    yes, no, path = F.lit(True), F.lit(False), F.col("path")
    columns = files.columns if "preference_score" in files.columns else [*files.columns, "preference_score"]
    old_score = F.col("preference_score") if "preference_score" in files.columns else F.lit(0)
    folded = F.col("file_key").eqNullSafe(fold_case(path))
    rows = files.withColumns({"__old_score": old_score, "__by_hand": _score(no, yes), "__plain": _score(no, no), "__there": F.col("status") != "Missing",
                              "__folded": folded, "__key": F.when(~folded, F.col("file_key"))}).drop("file_key", "preference_score")
    key = F.when(F.col("__folded"), fold_case(path)).otherwise(F.col("__key"))
    marked = _named_rows(rows, overrides, key)

    held = ["game_key", "path", "__folded", "__key", "file_group"]
    others = [name for name in files.columns if name not in (*held, "file_key", "preference_score", *_FLAG_BITS)]
    scores = F.lit(0).cast("long")
    for name in ("__by_hand", "__plain"):
        scores = scores + in_bits(F.col(name) - _LEAST_SCORE, _SCORE_BITS[name])
    at_home = marked.filter(F.col("game_key").isNotNull()).select(
        *held, _packed_flags().alias("__flags"), scores.alias("__scores"), "__old_score", *others)

    def opened(met: DataFrame) -> DataFrame:
        return met.withColumns({"file_key": key, **{name: _flag(name) for name in _FLAG_BITS},
                                **{name: (bits(F.col("__scores"), _SCORE_BITS[name], 16) + _LEAST_SCORE).cast("int") for name in ("__by_hand", "__plain")}})

    # A file without a key is nobody's sibling.
    sibling = F.coalesce(F.col("chosen") != F.col("file_key"), F.lit(False))
    score = (F.when(F.col("is_excluded"), _score(yes, no)).when(~sibling & F.col("is_manual"), F.col("__by_hand"))
             .otherwise(F.col("__plain")))
    touched = opened(at_home.join(chosen, "game_key")).withColumn("preference_score", score)
    winners = best_units(touched, F.col("__there")).withColumnRenamed("unit_key", "__winner")
    decided = chosen.join(winners.select("game_key", "__winner"), "game_key").withColumn("__touched", F.lit(True))
    part = F.coalesce("__touched", F.lit(False))
    settled = opened(at_home.join(decided, "game_key", "left")).withColumns({
        "is_manual": F.when(sibling, False).otherwise(F.col("is_manual")),
        "is_preferred": F.when(part, is_winner("__winner")).otherwise(F.col("is_preferred")),
        "preference_score": F.when(part, score).otherwise(F.col("__old_score"))})
    homeless = marked.filter(F.col("game_key").isNull()).withColumns({"file_key": key, "preference_score": F.col("__old_score")})
    return settled.select(columns).unionByName(homeless.select(columns))


def exclude_non_preferred(files: DataFrame, game_keys: DataFrame) -> DataFrame:
    """In the given games exclude every present copy that is not preferred, then elect.

    Missing files are left out of both steps and keep their flags.
    """
    excluded = F.when(~F.col("is_preferred"), True).otherwise(F.col("is_excluded"))
    return _elect_in_games(files, game_keys, F.col("status") != "Missing", {"is_excluded": excluded})


def clear_overrides(files: DataFrame, game_keys: DataFrame) -> DataFrame:
    """Drop manual choices and exclusions in the given games, then elect again."""
    return _elect_in_games(files, game_keys, F.lit(True), {"is_manual": F.lit(False), "is_excluded": F.lit(False)})


def set_wanted(games: DataFrame, game_keys: DataFrame, wanted: bool) -> DataFrame:
    marks = game_keys.select("game_key").distinct().withColumn("__hit", F.lit(True))
    return (games.join(marks, "game_key", "left")
            .withColumn("is_wanted", F.when(F.col("__hit"), F.lit(wanted)).otherwise(F.col("is_wanted")))
            .drop("__hit"))
