"""Library views: summaries, filters, pages, counts and report rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfmark.fixed_values import REVIEW_CONFIDENCE
from shelfmark.functions.packing import (bits, can_join, hex_forms, hex_text, in_bits, join_texts, pack_size_and_time, short_digest, split_texts,
                                         text_at, text_of, unpack_size, unpack_time)
from shelfmark.functions.text import base_name, fold_case
from shelfmark.plans.skew import broadcast_if_small


def list_systems(systems: DataFrame) -> DataFrame:
    return systems.orderBy("system_name", "system_key")


def list_locations(locations: DataFrame, enabled_only: bool = False) -> DataFrame:
    rows = locations.filter("enabled") if enabled_only else locations
    return rows.orderBy("location")


# --- filters ----------------------------------------------------------------

def _like(text: Column, term: str) -> Column:
    """LIKE '%term%' with ASCII-only case folding; ``%`` and ``_`` in the term stay wildcards.

    Written as a search pattern: it stops at the first hit, folds case without
    rewriting the text, and no sign of the term can act as an escape.
    """
    parts = {"%": ".*", "_": "."}
    pattern = "".join(parts.get(sign, re.escape(sign)) for sign in term.strip("%"))
    return text.rlike("(?is)" + pattern)


def search_games(games: DataFrame, files: DataFrame, term: str | None) -> DataFrame:
    """Games whose title, or any file name or path, holds the term."""
    if term is None or not term.strip():
        return games
    word = term.strip()
    by_file = (files.filter(_like(F.col("file_name"), word) | _like(F.col("path"), word))
               .select("game_key").distinct().withColumn("__by_file", F.lit(True)))
    return (games.join(by_file, "game_key", "left")
            .filter(_like(F.col("title"), word) | F.col("__by_file")).drop("__by_file"))


def filter_system(games: DataFrame, system_key: str | None) -> DataFrame:
    return games if system_key is None else games.filter(F.col("system_key") == system_key)


def needs_review() -> Column:
    return ((F.col("confidence") < REVIEW_CONFIDENCE)
            | F.col("catalog_status").isin("NoMatch", "Error", "Unsupported"))


_FILE_CONDITIONS = {
    "Verified": lambda: F.col("catalog_status") == "Verified",
    "Unverified": lambda: (F.col("status") != "Missing") & (F.col("catalog_status") != "Verified"),
    "ExactDuplicates": lambda: F.col("status") == "Duplicate",
    "Missing": lambda: F.col("status") == "Missing",
    "NeedsReview": needs_review,
    "PreferredCopies": lambda: F.col("is_preferred"),
}


def view_games(games: DataFrame, files: DataFrame, view: str = "All") -> DataFrame:
    """Games of one library view. File conditions are reduced to keys before the join."""
    if view == "All":
        return games
    if view == "Wanted":
        return games.filter("is_wanted")
    if view == "MultipleVersions":
        keys = (files.filter(F.col("status") != "Missing").groupBy("game_key")
                .agg(F.count("*").alias("n")).filter("n > 1").select("game_key"))
    elif view in _FILE_CONDITIONS:
        keys = files.filter(_FILE_CONDITIONS[view]()).select("game_key").distinct()
    else:
        raise ValueError(f"unknown view {view!r}")
    return games.join(keys, "game_key", "left_semi")


# --- summaries --------------------------------------------------------------

def file_rollup(files: DataFrame) -> DataFrame:
    """All per-game file figures in one aggregation."""
    present = F.col("status") != "Missing"
    region_order = F.struct((~F.col("is_preferred")).alias("other"), F.col("file_key").alias("file_key"))
    return files.filter(F.col("game_key").isNotNull()).groupBy("game_key").agg(
        F.count("*").alias("file_count"),
        F.count_if(F.col("status") == "Duplicate").alias("duplicate_count"),
        F.count_if(F.col("catalog_status") == "Verified").alias("verified_count"),
        F.count_if(~present).alias("missing_count"),
        F.min_by("catalog_name", F.when(F.col("is_preferred"), F.col("file_key"))).alias("preferred_catalog_name"),
        F.min_by("region", region_order).alias("preferred_region"),
        F.sum(F.when(present, F.col("size"))).alias("total_size"))


def game_summary(games: DataFrame, files: DataFrame, systems: DataFrame) -> DataFrame:
    """One row per game, games without files included."""
    joined = (games.join(file_rollup(files), "game_key", "left")
              .join(systems.select("system_key", "system_name"), "system_key"))
    zero = F.lit(0).cast("long")
    counts = {name: F.coalesce(name, zero) for name in
              ("file_count", "duplicate_count", "verified_count", "missing_count", "total_size")}
    joined = joined.withColumns(counts)
    worst = (F.when(F.col("missing_count") > 0, "Missing").when(F.col("duplicate_count") > 0, "Duplicate")
             .otherwise("Normal"))
    return joined.select("game_key", "title", "system_name", "system_key", "file_count", "duplicate_count",
                         "verified_count", worst.alias("worst_status"), "preferred_catalog_name",
                         "preferred_region", "total_size", "is_wanted")


def page_games(games: DataFrame, files: DataFrame, systems: DataFrame, skip: int, take: int, *,
               view: str = "All", system_key: str | None = None, term: str | None = None) -> DataFrame:
    """One page of summaries in sort-title order with a ``has_more`` flag.

    The page is cut from the game table first, so only the files of its
    ``take`` games are aggregated. The page is bounded by ``take``, which is
    what makes its keys safe to broadcast.
    """
    if skip < 0:
        raise ValueError("skip must not be negative")
    if take <= 0:
        raise ValueError("take must be positive")
    rows = view_games(search_games(filter_system(games, system_key), files, term), files, view)
    cut = rows.orderBy("sort_title", "game_key").offset(skip).limit(take + 1)
    # Windows over at most take + 1 rows.
    numbered = (cut.withColumn("position", F.row_number().over(Window.orderBy("sort_title", "game_key")))
                .withColumn("has_more", F.count("*").over(Window.partitionBy()) > take)
                .filter(F.col("position") <= take))
    page_keys = F.broadcast(numbered.select("game_key"))
    summary = game_summary(numbered.drop("position", "has_more"), files.join(page_keys, "game_key", "left_semi"), systems)
    flags = F.broadcast(numbered.select("game_key", "position", "has_more"))
    return summary.join(flags, "game_key").orderBy("position")


def page_after(games: DataFrame, last_sort_title: str, last_key, take: int) -> DataFrame:
    """The next page by key instead of by offset: costs the same however deep."""
    later = ((F.col("sort_title") > last_sort_title)
             | ((F.col("sort_title") == last_sort_title) & (F.col("game_key") > F.lit(last_key))))
    return games.filter(later).orderBy("sort_title", "game_key").limit(take)


def search_unbounded(games: DataFrame, files: DataFrame, systems: DataFrame, *, view: str = "All",
                     system_key: str | None = None, term: str | None = None) -> DataFrame:
    """All matching summaries in sort-title order."""
    rows = view_games(search_games(filter_system(games, system_key), files, term), files, view)
    order = rows.select("game_key", "sort_title")
    return game_summary(rows, files, systems).join(order, "game_key").orderBy("sort_title", "game_key")


def library_counts(games: DataFrame, files: DataFrame) -> DataFrame:
    """One row: games, files, duplicates, missing, verified. Each table is read once."""
    one, nothing = F.lit(1).cast("long"), F.lit(0).cast("long")
    def flag(condition):
        return F.when(condition, one).otherwise(nothing)
    g = games.select(one.alias("games"), *[nothing.alias(n) for n in ("files", "duplicates", "missing", "verified")])
    f = files.select(nothing.alias("games"), one.alias("files"),
                     flag(F.col("status") == "Duplicate").alias("duplicates"),
                     flag(F.col("status") == "Missing").alias("missing"),
                     flag(F.col("catalog_status") == "Verified").alias("verified"))
    return g.unionByName(f).agg(*[F.coalesce(F.sum(n), nothing).alias(n)
                                  for n in ("games", "files", "duplicates", "missing", "verified")])


def games_per_system(games: DataFrame) -> DataFrame:
    """Games per system and, with a null system, over all."""
    return games.rollup("system_key").agg(F.count("*").alias("games"))


# What the inventory report takes from a file besides its names.
_REPORT_TEXTS = ["catalog_name", "quick_hash", "region", "revision", "status", "catalog_status", "catalog_source", "format_name", "language",
                 "version"]
_REPORT_FLAGS = ["is_preferred", "is_manual", "is_excluded"]
# A packed row is a line of bytes (hashes, path, texts, texts of the game) and its shape, a number: first bit and number of bits.
# Lengths are of bytes; that of the location is of what the path begins with, that of the sort title is one more and 0 for the title again.
_FLAGS, _SHA256, _SHA1, _OWNED = (0, 3), (3, 2), (5, 2), (7, 1)
_PATH, _LOCATION, _SYSTEM, _TITLE, _SORT_TITLE = (8, 16), (24, 8), (32, 8), (40, 12), (52, 11)
#: Bits and bytes of the usual hashes.
_HASHES = {"SHA256": (_SHA256, 32), "SHA1": (_SHA1, 20)}


def _packed_files(files: DataFrame) -> DataFrame:
    """Files as game key, score, size with time, shape and bytes. What has no place there travels whole beside it."""
    columns = dict(files.dtypes)
    path, location, flags = F.col("path"), F.col("location"), [F.col(name) for name in _REPORT_FLAGS]
    located = F.coalesce(path.startswith(location) & (F.octet_length(location) < 1 << _LOCATION[1]), F.lit(False))
    texts = [F.col(name) for name in _REPORT_TEXTS] + [F.when(F.col("__located"), "").otherwise(location)]
    fits = ((F.octet_length(path) < 1 << _PATH[1]) & (F.col("file_key") == fold_case(path)) & (F.col("file_name") == base_name(path)) & can_join(*texts))
    for flag in flags:
        fits = fits & flag.isNotNull()
    known = (files.withColumns({"__numbers": pack_size_and_time(F.col("size"), F.col("modified"), columns["modified"]), "__located": located})
             .withColumn("__fits", F.coalesce(fits & F.col("__numbers").isNotNull(), F.lit(False))))
    shape = in_bits(F.octet_length(path), _PATH[0]) + F.when(F.col("__located"), in_bits(F.octet_length(location), _LOCATION[0])).otherwise(0)
    for place, flag in enumerate(flags):
        shape = shape + in_bits(flag, _FLAGS[0] + place)
    whole = F.struct("path", "file_key", "file_name", "size", "modified", "location", *_REPORT_TEXTS, *flags)
    packed, line = F.col("__fits"), F.concat(path, join_texts(*texts)).cast("binary")
    return known.select(F.when(~packed, whole).alias("__whole"), "preference_score", "game_key", F.when(packed, F.col("__numbers")).alias("__numbers"),
                        F.when(packed, shape).otherwise(0).alias("__shape"), F.when(packed, line).otherwise(F.lit(b"")).alias("__line"))


def _packed_owners(games: DataFrame, systems: DataFrame) -> DataFrame:
    names = ["system_name", "title", "sort_title"]
    system, title, sort_title = (F.octet_length(name) for name in names)
    fits = F.coalesce((system < 1 << _SYSTEM[1]) & (title < 1 << _TITLE[1]) & (sort_title < (1 << _SORT_TITLE[1]) - 1), F.lit(False))
    same = F.col("sort_title") == F.col("title")
    shape = (in_bits(F.lit(1), _OWNED[0]) + in_bits(system, _SYSTEM[0]) + in_bits(title, _TITLE[0])
             + in_bits(F.when(same, 0).otherwise(sort_title + 1), _SORT_TITLE[0]))
    line = F.concat("system_name", "title", F.when(same, "").otherwise(F.col("sort_title"))).cast("binary")
    return (games.select("game_key", "system_key", "title", "sort_title")
            .join(broadcast_if_small(systems.select("system_key", "system_name")), "system_key")
            .select("game_key", F.when(~fits, F.struct(*names)).alias("__game"),
                    F.when(fits, shape).alias("__game_shape"), F.when(fits, line).alias("__game_line")))


def _greatest_hashes(hashes: DataFrame) -> DataFrame:
    """By digest of the file key: the greatest hash of each kind in each form."""
    known = hashes.filter(F.col("algorithm").isin(*_HASHES) & F.col("file_key").isNotNull()).select(
        short_digest(F.col("file_key")).alias("__digest"), "algorithm", *[form.alias(f"__form{n}") for n, form in enumerate(hex_forms(F.col("hash")))])
    return known.groupBy("__digest").agg(*[F.max(F.when(F.col("algorithm") == kind, F.col(f"__form{n}"))).alias(f"__{kind}_{n}")
                                           for kind in _HASHES for n in range(3)])


def _with_hashes(shape: Column, line: Column) -> dict[str, Column]:
    """Shape and bytes with the hashes in front; an unusual hash stays beside them as text."""
    data, texts = [], {}
    for kind, (place, length) in _HASHES.items():
        lower, upper, plain = (F.col(f"__{kind}_{n}") for n in range(3))
        held = F.coalesce(lower, upper)
        usual = F.coalesce(F.octet_length(held) == length, F.lit(False)) & plain.isNull() & (lower.isNull() | upper.isNull())
        shape = shape + in_bits(F.when(~usual, 0).when(lower.isNotNull(), 1).otherwise(2), place[0])
        data.append(F.when(usual, held).otherwise(F.lit(b"")))
        texts[f"__{kind}"] = F.when(~usual, hex_text(lower, upper, plain))
    return {**texts, "__shape": shape, "__line": F.concat(*data, line)}


def _packed_hash(kind: str) -> Column:
    shape, (place, length) = F.col("__shape"), _HASHES[kind]
    start = 1 if kind == "SHA256" else F.when(bits(shape, *_SHA256) > 0, 33).otherwise(1)
    digits = F.hex(F.substring(F.col("__line"), start, length))
    return F.when(bits(shape, *place) == 1, F.lower(digits)).when(bits(shape, *place) == 2, digits).otherwise(F.col(f"__{kind}"))


def _path_start() -> Column:
    shape = F.col("__shape")
    return F.when(bits(shape, *_SHA256) > 0, 32).otherwise(0) + F.when(bits(shape, *_SHA1) > 0, 20).otherwise(0)


def _packed_path() -> Column:
    return F.when(F.col("__whole").isNull(), text_at(F.col("__line"), _path_start(), bits(F.col("__shape"), *_PATH))).otherwise(F.col("__whole.path"))


def _packed_key(path: Column) -> Column:
    return F.when(F.col("__whole").isNull(), fold_case(path)).otherwise(F.col("__whole.file_key"))


def _packed_name(path: Column) -> Column:
    return F.when(F.col("__whole").isNull(), base_name(path)).otherwise(F.col("__whole.file_name"))


def _owner_lengths() -> tuple[Column, Column, Column]:
    system, title, sort_title = (bits(F.col("__shape"), *place) for place in (_SYSTEM, _TITLE, _SORT_TITLE))
    return system, title, F.greatest(sort_title - 1, F.lit(0))


def _owner_texts() -> dict[str, Column]:
    """System, title and sort title of the row's game, null where it has none."""
    shape, line, end = F.col("__shape"), F.col("__line"), F.octet_length("__line")
    system, title, sort_title = _owner_lengths()
    titled = text_at(line, end - sort_title - title, title)
    sorted_by = F.when(bits(shape, *_SORT_TITLE) == 0, titled).otherwise(text_at(line, end - sort_title, sort_title))
    texts = {"system_name": text_at(line, end - sort_title - title - system, system), "title": titled, "sort_title": sorted_by}
    return {f"__{name}": F.when(bits(shape, *_OWNED) == 1, text).otherwise(F.col(f"__game.{name}")) for name, text in texts.items()}


def _packed_texts() -> Column:
    line, start = F.col("__line"), _path_start() + bits(F.col("__shape"), *_PATH)
    system, title, sort_title = _owner_lengths()
    return split_texts(text_at(line, start, F.octet_length(line) - start - system - title - sort_title))


def inventory_rows(files: DataFrame, games: DataFrame, systems: DataFrame, hashes: DataFrame) -> DataFrame:
    """The 23-column inventory report in system, title, file order.

    Whole rows move three times: to their games, to their hashes and to their place in the report. They do so packed, without
    what the path tells, hashes as bytes, and meet the hashes by a digest of the file key.
    """
    shape, line = F.col("__shape"), F.col("__line")
    apart = ["__whole", "__game", "preference_score", "__numbers"]
    owned = _packed_files(files).join(_packed_owners(games, systems), "game_key", "left").select(
        *apart, (shape + F.coalesce("__game_shape", F.lit(0))).alias("__shape"), F.concat(line, F.coalesce("__game_line", F.lit(b""))).alias("__line"))
    met = owned.join(_greatest_hashes(hashes), short_digest(_packed_key(_packed_path())) == F.col("__digest"), "left").select(
        *apart, *[value.alias(name) for name, value in _with_hashes(shape, line).items()])

    owner, path = _owner_texts(), _packed_path()
    order = [owner["__system_name"], owner["__sort_title"], _packed_name(path), _packed_key(path)]
    placed = (met.repartitionByRange(*[F.asc_nulls_first(value) for value in order]).withColumns({**owner, "__path": path})
              .withColumns({"__name": _packed_name(F.col("__path")), "__key": _packed_key(F.col("__path"))})
              .sortWithinPartitions(*[F.asc_nulls_first(name) for name in ("__system_name", "__sort_title", "__name", "__key")])
              .withColumn("__texts", F.when(F.col("__whole").isNull(), _packed_texts())))

    def either(name: str, packed: Column) -> Column:
        return F.when(F.col("__whole").isNull(), packed).otherwise(F.col(f"__whole.{name}"))

    numbers = F.col("__numbers")
    values = {name: either(name, text_of(F.col("__texts")[n])) for n, name in enumerate([*_REPORT_TEXTS, "location"])}
    located = bits(shape, *_LOCATION)
    values["location"] = F.when(located > 0, text_at(line, _path_start(), located)).otherwise(values["location"])
    values |= {name: either(name, bits(shape, _FLAGS[0] + n, 1) == 1) for n, name in enumerate(_REPORT_FLAGS)}
    values |= {"system": F.coalesce("__system_name", F.lit("")), "game_title": F.coalesce("__title", F.lit("")), "path": F.col("__path"),
               "file_name": F.col("__name"), "source_folder": values["location"], "format": F.coalesce(values["format_name"], F.lit("")),
               "size": either("size", unpack_size(numbers)), "modified": either("modified", unpack_time(numbers, dict(files.dtypes)["modified"])),
               "preference_score": F.col("preference_score"), **{kind.lower(): _packed_hash(kind) for kind in _HASHES}}
    return placed.select(*[values[name].alias(name) for name in (
        "system", "game_title", "file_name", "path", "source_folder", "format", "size", "modified", "region", "language", "revision",
        "version", "status", "catalog_status", "catalog_source", "catalog_name", "is_preferred", "is_manual", "is_excluded",
        "preference_score", "quick_hash", "sha256", "sha1")])


def game_details(games: DataFrame, files: DataFrame, systems: DataFrame, formats: DataFrame, game_key_value) -> DataFrame:
    """One game with its system, one row per file with its format; the game alone if it has none."""
    one = games.filter(F.col("game_key") == F.lit(game_key_value))
    wanted = files.filter(F.col("game_key") == F.lit(game_key_value))
    return details_of(one, wanted, systems, formats)


def details_of(games: DataFrame, files: DataFrame, systems: DataFrame, formats: DataFrame) -> DataFrame:
    """Games joined to system, files and formats; long form, so no game is ever one row of a list."""
    described = files.drop("system_key").join(
        games.select("game_key", "system_key"), "game_key").join(
        formats.select("system_key", "extension", "format_name", "format_type", "priority"),
        ["system_key", "extension", "format_name"], "left").drop("system_key")
    return (games.select("game_key", "system_key", "title", "sort_title", "is_wanted")
            .join(systems.select("system_key", "system_name", "manufacturer"), "system_key")
            .join(described.select("game_key", "file_key", "file_name", "path", "size", "status",
                                   "catalog_status", "format_name", "format_type", "priority"), "game_key", "left"))


def preferred_export_files(files: DataFrame, games: DataFrame, systems: DataFrame,
                           only_wanted: bool = False) -> DataFrame:
    """Preferred, present files of known games in system, file order."""
    owners = games.filter("is_wanted") if only_wanted else games
    return (files.filter(F.col("is_preferred") & (F.col("status") != "Missing"))
            .select("game_key", "path", "file_name", "is_directory", "size")
            .join(owners.select("game_key", "system_key"), "game_key")
            .join(systems.select("system_key", "system_name"), "system_key")
            .select("system_name", "path", "file_name", "is_directory", "size")
            .orderBy("system_name", "file_name", "path"))
