"""What changed since the last listing, and the file table that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions.text import base_name, fold_case, normalise_extension, parent_of
from shelfmark.plans.ordered import running_maximum
from shelfmark.plans.skew import broadcast_if_small, lookup_join
from shelfmark.session import shared_folder

#: Columns a new or changed file takes from the scan.
SCANNED = ["path", "file_name", "extension", "size", "created", "modified", "location", "game_key", "system_key",
           "format_name", "region", "language", "revision", "version", "disc_number", "track_number",
           "quick_hash", "is_directory", "confidence", "reason"]
#: Columns of the file table in order.
FILE_COLUMNS = ["file_key", *SCANNED, "file_group", "status", "catalog_status", "catalog_source", "catalog_name",
                "catalog_verified_at", "is_preferred", "is_manual", "is_excluded", "preference_score",
                "is_detection_manual", "last_seen"]


def with_file_key(listing: DataFrame) -> DataFrame:
    """Adds the case-folded key and keeps one row per key, that of the first raw path.

    Only keys that several rows may share are gathered; hashes of the keys find them, so all other rows stay where they are.
    """
    names = listing.columns
    keyed = listing.withColumn("file_key", fold_case(F.col("path")))
    shared = (keyed.groupBy(F.xxhash64("file_key").alias("__hash")).agg(F.count("*").alias("__rows")).filter("__rows > 1").select("__hash"))
    marked = keyed.withColumn("__hash", F.xxhash64("file_key")).join(
        broadcast_if_small(shared.withColumn("__shared", F.lit(True))), "__hash", "left")
    first = (marked.filter("__shared").groupBy("file_key").agg(F.min_by(F.struct(*names), F.col("path")).alias("__row"))
             .select("file_key", "__row.*"))
    return marked.filter("__shared IS NULL").select("file_key", *names).unionByName(first)


def fresh_only(keyed: DataFrame, previous: DataFrame, described: tuple[str, ...] = ("path", "file_name", "extension")) -> DataFrame:
    """``keyed`` rows with the ``described`` columns null where the previous table has the same size and time.

    What is worked out from those columns then costs nothing for unchanged files, while all rows stay
    dealt by their key for the join that follows.
    """
    old = previous.select("file_key", F.struct("size", "modified").alias("__old"))
    same = F.col("__old").isNotNull() & F.col("size").eqNullSafe(F.col("__old.size")) & F.col("modified").eqNullSafe(F.col("__old.modified"))
    joined = keyed.join(old, "file_key", "left").withColumn("__same", same)
    return joined.withColumns({name: F.when(~F.col("__same"), F.col(name)) for name in described}).drop("__old", "__same")


def path_clashes(listing: DataFrame) -> DataFrame:
    """Keys that several distinct paths share, so nothing merges unseen."""
    return (listing.groupBy(fold_case(F.col("path")).alias("file_key"))
            .agg(F.count("*").alias("paths"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
            .filter("paths > 1"))


def diff_listing(previous: DataFrame, listing: DataFrame) -> DataFrame:
    """Full outer comparison: file_key, location, sizes, times and ``change``.

    unchanged = same size and same time; changed; added; unseen. Both sides are
    unique on the key, so one co-partitioned join decides every row.
    """
    fields = ["path", "size", "modified", "location"]
    old_status = F.col("status") if "status" in previous.columns else F.lit("Normal")
    last_seen = F.col("last_seen") if "last_seen" in previous.columns else F.lit(None).cast("timestamp")
    old = previous.select("file_key", F.struct(*fields, old_status.alias("status"), last_seen.alias("last_seen")).alias("old"))
    new = with_file_key(listing.select(*fields)).select("file_key", F.struct(*fields).alias("new"))
    same = F.col("old.size").eqNullSafe(F.col("new.size")) & F.col("old.modified").eqNullSafe(F.col("new.modified"))
    change = (F.when(F.col("new").isNull(), "unseen").when(F.col("old").isNull(), "added")
              .when(same, "unchanged").otherwise("changed"))
    return (old.join(new, "file_key", "full_outer").withColumn("change", change)
            .select("file_key", F.coalesce("new.location", "old.location").alias("location"),
                    F.col("old.size").alias("old_size"), F.col("new.size").alias("new_size"),
                    F.col("old.modified").alias("old_modified"), F.col("new.modified").alias("new_modified"),
                    F.col("old.status").alias("old_status"), F.col("old.last_seen").alias("old_last_seen"), "change"))


def listing_health(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Per run location: unreadable paths, and whether missing files may be marked.

    ``errors``: location, path; one row per unreadable path.
    """
    counted = errors.groupBy("location").agg(F.count("*").alias("error_count"))
    return (runs.join(counted, "location", "left")
            .withColumn("error_count", F.coalesce("error_count", F.lit(0).cast("long")))
            .withColumn("complete", F.col("error_count") == 0))


def scan_counters(diff: DataFrame, supported: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """One row of run totals.

    ``runs``: location, started, complete. An unseen file is missing only if the run
    of its location was complete and began after the file was last seen (a file
    without such a time counts). Without ``runs`` every location counts as listed in full.

    ``supported``: file_key, supported, failed per listed row. Without it every
    listed row counts as supported and read.
    """
    rows = diff
    if supported is None:
        rows = rows.withColumn("supported", F.lit(True)).withColumn("failed", F.lit(False))
    else:
        rows = rows.join(supported.select("file_key", "supported", "failed"), "file_key", "left")
    listed = F.col("change") != "unseen"
    gone = (F.col("change") == "unseen") & (F.col("old_status") != "Missing")
    if runs is not None:
        known = runs.select("location", "started", F.col("complete").alias("run_complete"))
        rows = rows.join(broadcast_if_small(known), "location", "left")
        gone = gone & F.coalesce("run_complete", F.lit(False)) & F.coalesce(F.col("old_last_seen") < F.col("started"), F.lit(True))
    ok = listed & F.coalesce("supported", F.lit(True))
    read = ok & ~F.coalesce("failed", F.lit(False))
    def total(condition):
        return F.count_if(condition)
    return rows.agg(
        total(listed).alias("discovered"),
        total(read & F.col("change").isin("added", "changed")).alias("processed"),
        (total(listed & ~F.col("supported")) + total(ok & (F.col("change") == "unchanged"))).alias("skipped"),
        total(read & (F.col("change") == "added")).alias("added"),
        total(read & (F.col("change") == "changed")).alias("changed"),
        total(gone).alias("missing"),
        total(ok & (F.col("change") == "unchanged")).alias("unchanged"),
        total(listed & ~F.col("supported")).alias("unsupported"),
        total(ok & F.coalesce("failed", F.lit(False))
              & F.col("change").isin("added", "changed")).alias("errors"))


def unsupported_histogram(listing: DataFrame, formats: DataFrame) -> DataFrame:
    """Files per extension that no format claims, most frequent first."""
    known = broadcast_if_small(formats.select(F.col("extension").alias("known_extension")).distinct())
    rows = listing.join(known, normalise_extension(listing["extension"]) == F.col("known_extension"), "left_anti")
    return (rows.groupBy(F.lower("extension").alias("extension")).agg(F.count("*").alias("files"))
            .orderBy(F.desc("files"), "extension"))


def apply_scan(previous: DataFrame, scanned: DataFrame, runs: DataFrame) -> DataFrame:
    """The next version of the file table.

    ``scanned``: listing rows with the SCANNED columns, ``file_group``,
    ``supported`` and ``failed``, and ``file_key`` if they are one row per key already;
    ``runs``: location, started, complete.

    New and changed files take all scanned fields and lose catalog state and
    flags, but keep manual choice, exclusion and, lacking a new one, their
    group. Everything else that was listed is touched. Known files of a
    complete run that were not listed become Missing; rows are never deleted.
    """
    keyed = scanned if "file_key" in scanned.columns else with_file_key(scanned)
    old = previous.select("file_key", F.struct(*FILE_COLUMNS[1:]).alias("old"))
    new = keyed.select("file_key", F.struct(*SCANNED, "file_group", "supported", "failed").alias("new"))
    rows = (old.join(new, "file_key", "full_outer")
            .withColumn("run_location", F.coalesce("old.location", "new.location"))
            .join(broadcast_if_small(runs.select(F.col("location").alias("run_location"), "started", "complete")),
                  "run_location", "left"))
    known, listed = F.col("old").isNotNull(), F.col("new").isNotNull()
    same = F.col("old.size").eqNullSafe(F.col("new.size")) & F.col("old.modified").eqNullSafe(F.col("new.modified"))
    replaced = listed & F.col("new.supported") & ~F.col("new.failed") & ~(known & same)
    rows = rows.withColumn("replaced", F.coalesce(replaced, F.lit(False))).filter(known | F.col("replaced"))
    fresh = F.col("replaced")

    def pick(name: str, when_new):
        return F.when(fresh, when_new).otherwise(F.col(f"old.{name}")).alias(name)

    gone = ~listed & F.coalesce("complete", F.lit(False)) & (F.col("old.last_seen") < F.col("started"))
    status = (F.when(fresh, "Normal").when(gone, "Missing")
              .when(listed & (F.col("old.status") == "Missing"), "Normal").otherwise(F.col("old.status")))
    return rows.select(
        "file_key",
        *[pick(name, F.col(f"new.{name}")) for name in SCANNED],
        pick("file_group", F.coalesce("new.file_group", "old.file_group")),
        status.alias("status"),
        pick("catalog_status", F.lit("Unknown")),
        *[pick(name, F.lit(None)) for name in ("catalog_source", "catalog_name", "catalog_verified_at")],
        pick("is_preferred", F.lit(False)),
        pick("is_manual", F.coalesce("old.is_manual", F.lit(False))),
        pick("is_excluded", F.coalesce("old.is_excluded", F.lit(False))),
        pick("preference_score", F.lit(0)),
        pick("is_detection_manual", F.lit(False)),
        F.when(listed, F.coalesce("started", "old.last_seen")).otherwise(F.col("old.last_seen")).alias("last_seen"))


def touch_unchanged(files: DataFrame, seen: DataFrame, started) -> DataFrame:
    """Files listed again: last seen now, Missing becomes Normal, other states stay."""
    hits = seen.select("file_key").distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit").isNotNull()
    return (files.join(hits, "file_key", "left")
            .withColumn("last_seen", F.when(hit, started).otherwise(F.col("last_seen")))
            .withColumn("status", F.when(hit & (F.col("status") == "Missing"), "Normal").otherwise(F.col("status")))
            .drop("__hit"))


def mark_missing(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files of a completely listed location that were last seen before its run began."""
    joined = files.join(broadcast_if_small(runs.select("location", "started", "complete")), "location", "left")
    gone = F.coalesce("complete", F.lit(False)) & (F.col("last_seen") < F.col("started"))
    return (joined.withColumn("status", F.when(gone, "Missing").otherwise(F.col("status")))
            .drop("started", "complete"))


def drop_replaced_hashes(hashes: DataFrame, replaced: DataFrame) -> DataFrame:
    """A changed file loses its stored hashes."""
    return hashes.join(replaced.select("file_key"), "file_key", "left_anti")


def purge_orphan_games(games: DataFrame, files: DataFrame) -> DataFrame:
    """Games that still have files."""
    return games.join(files.select("game_key").distinct(), "game_key", "left_semi")


def remove_location(files: DataFrame, hashes: DataFrame, games: DataFrame,
                    location: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of one location go, with their hashes and the games left without files."""
    removed = files.filter(F.col("location") == location).select("file_key")
    kept = files.filter(~F.col("location").eqNullSafe(F.lit(location)))
    return kept, hashes.join(removed, "file_key", "left_anti"), purge_orphan_games(games, kept)


def begin_runs(locations: DataFrame, started: DataFrame) -> DataFrame:
    """``started``: location, started."""
    joined = locations.join(started.select("location", F.col("started").alias("__at")), "location", "left")
    return joined.withColumn("last_started", F.coalesce("__at", "last_started")).drop("__at")


def complete_runs(locations: DataFrame, finished: DataFrame) -> DataFrame:
    """``finished``: location, started, completed, file_count."""
    joined = locations.join(finished.select("location", F.struct("started", "completed", "file_count").alias("__run")),
                            "location", "left")
    return (joined.withColumn("last_started", F.coalesce("__run.started", "last_started"))
            .withColumn("last_completed", F.coalesce("__run.completed", "last_completed"))
            .withColumn("file_count", F.coalesce("__run.file_count", "file_count")).drop("__run"))


def add_locations(locations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Register new roots; a known path keeps its row. ``wanted``: location, recursive."""
    trimmed = wanted.withColumn("location", F.regexp_replace("location", r"(?<=[^/\\])[/\\]+\z", "")) \
                    .groupBy("location").agg(F.max("recursive").alias("recursive"))
    fresh = trimmed.join(locations.select("location"), "location", "left_anti")
    return locations.unionByName(fresh.withColumn("enabled", F.lit(True)), allowMissingColumns=True)


def update_locations(locations: DataFrame, settings: DataFrame) -> DataFrame:
    """Change enabled and recursive flags. ``settings``: location, enabled, recursive."""
    new = settings.select("location", F.struct("enabled", "recursive").alias("__new"))
    joined = locations.join(new, "location", "left")
    return (joined.withColumn("enabled", F.coalesce("__new.enabled", "enabled"))
            .withColumn("recursive", F.coalesce("__new.recursive", "recursive")).drop("__new"))


def interrupted_runs(locations: DataFrame) -> DataFrame:
    """Enabled locations whose last run began but did not finish."""
    return locations.filter(
        F.col("enabled") & F.col("last_started").isNotNull()
        & (F.col("last_completed").isNull() | (F.col("last_started") > F.col("last_completed"))))


def collapse_packages(listing: DataFrame, marker: str = V.PACKAGE_MARKER, subfolder: str = V.PACKAGE_SUBFOLDER,
                      extension: str = V.PACKAGE_EXTENSION) -> DataFrame:
    """Folders that hold the marker become one row; the files below are folded in.

    A first pass sums the files of each folder. Folders and packages are then swept in the order of the tree,
    where all that lies below a folder follows it without a gap: a package is open from its own place up to its end, the
    outermost open one has the greatest end, so a running maximum names the package of every folder,
    across the edges of the sorted ranges. A second pass keeps the files of folders outside packages.
    The scan root (``location``) itself is never a package.
    """
    parent, slash = parent_of(F.col("path")), F.lit("\0")
    shared_folder(listing.sparkSession)
    folders = listing.groupBy(parent.alias("folder")).agg(
        F.sum("size").alias("size"), F.max("modified").alias("modified"), F.count("*").alias("files"),
        F.min(F.when(F.col("file_name") == marker, F.struct("location", "path"))).alias("marker")).checkpoint()
    markers = folders.filter("marker IS NOT NULL").select("folder", F.col("marker.path").alias("marker_path"), F.col("marker.location").alias("location"))
    direct = markers.select(F.col("folder").alias("package"), F.lit(0).alias("rank"), "marker_path", "location")
    nested = markers.filter(F.col("folder").endswith(f"/{subfolder}")).select(
        parent_of(F.col("folder")).alias("package"), F.lit(1).alias("rank"), "marker_path", "location")
    packages = (direct.unionByName(nested)
                .filter(F.col("package").startswith(F.concat(F.rtrim("location", F.lit("/")), F.lit("/"))))
                .groupBy("package").agg(F.min_by("marker_path", "rank").alias("marker_path"),
                                        F.min("location").alias("location")))

    def place(name: str):
        # No name holds a NUL, and it sorts before all else: what lies below a folder is between folder + NUL and folder + 1.
        return F.concat(F.replace(F.col(name), F.lit("/"), slash), slash)

    opening = packages.select(place("package").alias("place"), F.lit(0).alias("kind"), F.struct(
        F.concat(F.replace(F.col("package"), F.lit("/"), slash), F.lit("\1")).alias("end"), "package").alias("opens"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("folder", "string"), ("size", "long"), ("files", "long"))],
        F.lit(None).cast(folders.schema["modified"].dataType).alias("modified"))
    inner = folders.select(place("folder").alias("place"), F.lit(1).alias("kind"),
                           F.lit(None).cast(opening.schema["opens"].dataType).alias("opens"), "folder", F.col("size").cast("long").alias("size"), "files", "modified")
    swept = running_maximum(opening.unionByName(inner), ["place", "kind"], "opens", "open")
    owned = (swept.filter((F.col("kind") == 1) & (F.col("open.end") > F.col("place")))
             .select("folder", F.col("open.package").alias("package"), "size", "modified", "files")).checkpoint()
    rolled = (owned.groupBy("package").agg(F.sum("size").alias("size"), F.max("modified").alias("modified"))
              .join(packages, "package"))
    rows = rolled.select(
        F.col("package").alias("path"), base_name(F.col("package")).alias("file_name"),
        F.lit(extension).alias("extension"), "size", F.lit(None).cast("timestamp").alias("created"), "modified",
        F.lit(True).alias("is_directory"), "marker_path", "location")
    covered = owned.select(F.col("folder").alias("__folder"), "package", "files")
    loose = (lookup_join(listing.withColumn("__folder", parent), covered, ["__folder"], "files", salt_on=["path"])
             .filter(F.col("package").isNull()).drop("__folder", "package", "files")
             .withColumn("is_directory", F.lit(False)).withColumn("marker_path", F.lit(None).cast("string")))
    return loose.select(rows.columns).unionByName(rows)
