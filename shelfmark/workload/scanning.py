"""Listings, identification, reconciliation and catalog files."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from shelfmark import model
from shelfmark.functions import text
from shelfmark.operators import aliases, curation, identify, reconcile, resolve
from shelfmark.plans import scan_job
from shelfmark.session import scratch_path
from shelfmark.sources import catalogs, listing as disk, tree
from shelfmark.sources.paths import local_path
from shelfmark.workload.base import Tables, choose, query, with_ctes
from shelfmark.workload.naming import PARSE_CTES, parsed_names

_SOME_EXTENSIONS = [".iso", ".bin", ".cue", ".zip", ".chd", ".nes", ".txt", ".PCE", ".xex", ".dsk", "", ".7z", ".pkg"]


def _folder_sql() -> str:
    """A folder per order: the system key as segment, token, substring, name or not at all."""
    rows = model.platform_rows()[0]
    names = choose("o_custkey", [row[2].replace("'", "''").lower() for row in rows])
    key = choose("o_custkey", [row[1].lower() for row in rows])
    arms = {0: key, 1: f"{key} || '_Games'", 2: f"'x' || {key} || 'x'", 3: f"'My ' || {names} || ' files'",
            4: "'misc'", 5: f"'a-' || {key}"}
    return "CASE o_orderkey % 6 " + " ".join(f"WHEN {n} THEN {expr}" for n, expr in arms.items()) + " END"


# orders as a fresh listing of one location.
LISTING_VIEW = f"""
SELECT order_key, '/roms/' || folder || '/' || file_name AS path, file_name, lower(extension) AS extension, size,
  CAST(NULL AS TIMESTAMP) AS created, modified, '/roms' AS location, status, priority
FROM (SELECT o_orderkey AS order_key, {_folder_sql()} AS folder,
        {choose('o_custkey', _SOME_EXTENSIONS)} AS extension,
        'Order ' || CAST(o_orderkey AS STRING) || {choose('o_custkey', _SOME_EXTENSIONS)} AS file_name,
        CAST(round(o_totalprice * 100) AS BIGINT) AS size, o_orderdate AS modified, o_orderstatus AS status,
        o_orderpriority AS priority FROM {{orders}}) a
"""

# What the run before knew: open and filled orders, some since changed, and the customers' files, since gone.
PREVIOUS_VIEW = """
SELECT upper(path) AS file_key, path, file_name, extension,
  CASE WHEN priority = '5-LOW' THEN size + 1 ELSE size END AS size, created,
  CASE WHEN priority = '4-NOT SPECIFIED' THEN modified + INTERVAL 1 DAY ELSE modified END AS modified, location,
  CASE WHEN priority = '2-HIGH' THEN 'Missing' WHEN priority = '3-MEDIUM' THEN 'Duplicate' ELSE 'Normal' END AS status,
  priority = '5-LOW' AS is_excluded, priority = '1-URGENT' AS is_manual, 'Disc 1' AS file_group, 'Verified' AS catalog_status
FROM {listing} WHERE status <> 'P'
UNION ALL
SELECT upper(path), path, path, '.old', bytes, CAST(NULL AS TIMESTAMP), TIMESTAMP '1994-01-01 00:00:00', '/roms',
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Missing' ELSE 'Normal' END, false, false, CAST(NULL AS STRING), 'Unknown'
FROM (SELECT '/roms/old/' || c_name AS path, CAST(round(abs(c_acctbal)) AS BIGINT) AS bytes, c_mktsegment FROM {customer}) a
"""

_LISTING_SQL = LISTING_VIEW.replace("{orders}", "orders")
_CTES = {"listing": _LISTING_SQL,
         "previous": PREVIOUS_VIEW.replace("{listing}", "listing").replace("{customer}", "customer")}
STARTED = "2003-01-01 00:00:00"
BEFORE = "2002-01-01 00:00:00"


def _listing(t: Tables):
    return t.spark.sql(LISTING_VIEW, orders=t.orders)


def _previous(t: Tables):
    return t.spark.sql(PREVIOUS_VIEW, listing=_listing(t), customer=t.customer)


# --- classify ------------------------------------------------------------------

def identify_ctes(source: str, prefix: str = "") -> dict[str, str]:
    """SQL for scored candidates and the best one of each row of ``source`` (id, path, extension)."""
    return {
        f"{prefix}words": f"""SELECT id, upper(path) AS folded, CASE WHEN starts_with(extension, '.') THEN lower(extension)
            ELSE '.' || lower(extension) END AS dotted,
            regexp_split_to_array(upper(path), '[^\\p{{L}}\\p{{Nd}}]+') AS words FROM {source}""",
        f"{prefix}scored": f"""SELECT l.id, f.*, f.priority
            + CASE WHEN contains(l.folded, '/' || f.system_key || '/') THEN 100
                   WHEN list_contains(l.words, f.system_key) THEN 90 ELSE 0 END
            + CASE WHEN contains(l.folded, upper(f.system_name)) THEN 75 ELSE 0 END
            + CASE WHEN count(*) OVER (PARTITION BY l.id) = 1 THEN 50 ELSE 0 END AS score
            FROM {prefix}words l JOIN formats f ON f.extension = l.dotted""",
        f"{prefix}ranked": f"""SELECT *, row_number() OVER w AS place, lead(score) OVER w AS runner_up,
            count(*) OVER (PARTITION BY id) AS claimants FROM {prefix}scored
            WINDOW w AS (PARTITION BY id ORDER BY score DESC, system_position, format_position)""",
        f"{prefix}best": f"""SELECT *, CAST(CASE WHEN claimants = 1 THEN 0.95 WHEN score > runner_up THEN 0.8 ELSE 0.5 END
            AS DOUBLE) AS confidence FROM {prefix}ranked WHERE place = 1""",
    }


_IDS = {"listing": _LISTING_SQL, "rows": "SELECT order_key AS id, path, extension FROM listing"}


@query("F1_is_candidate", with_ctes("formats", """SELECT order_key, path FROM listing
    WHERE extension IN (SELECT extension FROM formats)""", {"listing": _LISTING_SQL}))
def f1(t: Tables):
    return identify.supported_only(_listing(t), t.formats).select("order_key", "path")


@query("J2_identify_format", with_ctes("formats", """SELECT r.id AS order_key, b.system_key, b.format_name, b.score,
    CAST(coalesce(b.confidence, 0.0) AS DOUBLE) AS confidence, CASE WHEN b.id IS NULL THEN 'Unsupported extension'
      WHEN b.confidence <= 0.5 THEN 'Ambiguous extension; selected highest-priority format'
      ELSE 'Extension and path hints' END AS reason FROM rows r LEFT JOIN best b ON b.id = r.id""",
    {**_IDS, **identify_ctes("rows")}))
def j2(t: Tables):
    return identify.identify_format(_listing(t), t.formats).select(
        "order_key", "system_key", "format_name", "score", "confidence", "reason")


@query("R1_best_format", with_ctes("formats", """SELECT system_key, format_name, confidence, count(*) AS files
    FROM best GROUP BY ALL""", {**_IDS, **identify_ctes("rows")}))
def r1(t: Tables):
    scored = identify.score_candidates(identify.supported_only(_listing(t), t.formats), t.formats)
    return (identify.best_format(scored).groupBy("system_key", "format_name", "confidence")
            .agg(F.count("*").alias("files")))


# Order lines as the members of each order's archive.
_MEMBERS_SQL = """SELECT game_key AS order_key, size * 100000 + part_key AS position, file_name AS entry_name FROM files"""
_ARCHIVE_CTES = {
    **_IDS, **identify_ctes("rows"),
    "members": """SELECT l.order_key, l.path || '/' || m.entry_name AS path, m.position,
        regexp_extract(m.entry_name, '\\.[^.]*$') AS extension, row_number() OVER () AS id
        FROM listing l JOIN (""" + _MEMBERS_SQL + """) m ON m.order_key = l.order_key
        WHERE l.extension IN ('.zip', '.7z', '.rar')""",
    **identify_ctes("members", "inner_"),
    "inner_first": """SELECT * FROM (SELECT m.order_key, b.*, row_number() OVER (PARTITION BY m.order_key
        ORDER BY b.confidence DESC, m.position) AS n FROM inner_best b JOIN members m ON m.id = b.id) x WHERE n = 1""",
}


def _archive_entries(t: Tables):
    archives = _listing(t).filter(F.col("extension").isin(".zip", ".7z", ".rar")).select(
        F.col("order_key").alias("game_key"), F.col("path").alias("archive_path"))
    return t.files.select("game_key", (F.col("size") * 100000 + F.col("part_key")).alias("position"),
                          F.col("file_name").alias("entry_name")).join(archives, "game_key")


@query("J3_identify_archive", with_ctes("files formats", """SELECT l.order_key,
    CASE WHEN i.id IS NOT NULL THEN i.system_key ELSE b.system_key END AS system_key,
    CASE WHEN i.id IS NOT NULL THEN i.format_name ELSE b.format_name END AS format_name,
    CASE WHEN i.id IS NOT NULL THEN least(0.98, i.confidence + 0.03) ELSE coalesce(b.confidence, 0.0) END::DOUBLE AS confidence,
    CASE WHEN i.id IS NOT NULL THEN upper(substr(l.extension, 2)) || ' archive contains a recognized ' || i.system_name
      || ' file' WHEN b.id IS NULL THEN 'Unsupported extension'
      WHEN b.confidence <= 0.5 THEN 'Ambiguous extension; selected highest-priority format'
      ELSE 'Extension and path hints' END AS reason
    FROM listing l LEFT JOIN best b ON b.id = l.order_key LEFT JOIN inner_first i ON i.order_key = l.order_key""",
    _ARCHIVE_CTES))
def j3(t: Tables):
    found = identify.identify_with_archives(_listing(t), _archive_entries(t), t.formats)
    return found.select("order_key", "system_key", "format_name", "confidence", "reason")


@query("R2_best_archive_entry", with_ctes("files formats", """SELECT l.path AS archive_path, i.system_key, i.format_name,
    i.confidence FROM inner_first i JOIN listing l ON l.order_key = i.order_key""", _ARCHIVE_CTES))
def r2(t: Tables):
    return identify.best_archive_entry(_archive_entries(t), t.formats).select(
        "archive_path", "system_key", "format_name", "confidence")


@query("J5_resolve_format_id", with_ctes("formats", """SELECT r.id AS order_key, b.format_position, b.format_type
    FROM rows r JOIN best b ON b.id = r.id""", {**_IDS, **identify_ctes("rows")}))
def j5(t: Tables):
    found = identify.identify_format(_listing(t), t.formats).filter("system_key is not null")
    return identify.resolve_format(found, t.formats).select("order_key", "format_position", "format_type")


# --- resolve ---------------------------------------------------------------------

_PLAIN = "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')"
_KNOWN_GAMES = """SELECT system_key || ':' || normalised_title AS game_key, min(system_key) AS system_key,
    min('Known ' || title) AS title FROM part_games WHERE size < 25 GROUP BY 1"""


def _known_games(t: Tables):
    key = text.game_key(F.col("system_key"), F.col("normalised_title"))
    return (t.part_games.filter("size < 25").groupBy(key.alias("game_key"))
            .agg(F.min("system_key").alias("system_key"), F.min(F.concat(F.lit("Known "), "title")).alias("title"),
                 F.min("normalised_title").alias("normalised_title"))
            .withColumn("sort_title", F.col("title")).withColumn("is_wanted", F.lit(True)))


@query("J4_resolve_game", with_ctes("names part_games", f"""SELECT game_key, system_key, title FROM known UNION ALL
    SELECT game_key, system_key, title FROM (
      SELECT system_key || ':' || {_PLAIN} AS game_key, system_key, title,
        row_number() OVER (PARTITION BY system_key, {_PLAIN} ORDER BY upper(path), path) AS n FROM parsed) x
    WHERE n = 1 AND game_key NOT IN (SELECT game_key FROM known)""", {**PARSE_CTES, "known": _KNOWN_GAMES}))
def j4(t: Tables):
    return resolve.resolve_games(_known_games(t), parsed_names(t)).select("game_key", "system_key", "title")


# Two runs of merges, then files of the merged games change: parts of one brand and name go to the first of their type, then those
# that are left to the first of their size.
@query("J4_changed_files_of_merged_games", with_ctes("files", """SELECT file_key, coalesce(s.keep_key, f.keep_key, part_key) AS game_key
    FROM files LEFT JOIN one f ON f.game_key = part_key LEFT JOIN two s ON s.game_key = coalesce(f.keep_key, part_key)""", {
    "firsts": "SELECT p_partkey, p_brand, p_name, p_size, min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_type) AS keep_key FROM part",
    "one": "SELECT p_partkey AS game_key, keep_key FROM firsts WHERE keep_key <> p_partkey",
    "two": """SELECT * FROM (SELECT p_partkey AS game_key, min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_size) AS keep_key
        FROM firsts WHERE keep_key = p_partkey) a WHERE keep_key <> game_key"""}))
def j4_aliases(t: Tables):
    parts = t.part.select(F.col("p_partkey").alias("game_key"), "p_brand", "p_name", "p_type", "p_size")

    def first_of(rows, column: str):
        keep = rows.groupBy("p_brand", "p_name", column).agg(F.min("game_key").alias("keep_key"))
        return rows.join(keep, ["p_brand", "p_name", column]).filter("game_key <> keep_key").select("game_key", "keep_key")

    one = first_of(parts, "p_type")
    table = aliases.record_merges(aliases.empty_aliases(t.part_games), one)
    left = parts.join(one, "game_key", "left_anti")
    table = aliases.record_merges(table, first_of(left, "p_size"))
    return aliases.follow_aliases(t.part_files.select("file_key", "game_key"), table)


@query("J6_resolve_file_group", with_ctes("names", r"""SELECT part_key, CASE WHEN path LIKE '%.cue'
    OR track_number IS NOT NULL OR path LIKE '%.bin' THEN coalesce(CAST(disc_number AS STRING), '-') || '|'
    || CASE WHEN disc_number IS NOT NULL THEN 'Disc ' || CAST(disc_number AS STRING) ELSE title END END AS file_group
    FROM parsed""", PARSE_CTES))
def j6(t: Tables):
    extension = text.extension_of(F.col("file_name"))
    rows = (parsed_names(t).withColumn("extension", extension)
            .withColumn("is_multi_file", extension == ".cue")
            .withColumn("format_type", F.when(extension.isin(".bin", ".iso"), "DiscImage").otherwise("Rom")))
    return resolve.resolve_file_group(rows).select("part_key", "file_group")


# --- reconcile ---------------------------------------------------------------------

_DIFF = {**_CTES, "diff": """SELECT coalesce(upper(l.path), p.file_key) AS file_key, p.size AS old_size, l.size AS new_size,
    CASE WHEN l.path IS NULL THEN 'unseen' WHEN p.path IS NULL THEN 'added'
         WHEN l.size = p.size AND l.modified = p.modified THEN 'unchanged' ELSE 'changed' END AS change,
    p.status AS old_status, l.extension FROM previous p FULL JOIN listing l ON upper(l.path) = p.file_key""",
    "claimed": "SELECT DISTINCT extension FROM formats",
    "flagged": """SELECT d.*, c.extension IS NOT NULL AS supported FROM diff d
        LEFT JOIN claimed c ON c.extension = d.extension"""}


@query("J1_diff_listing", with_ctes("formats", "SELECT file_key, old_size, new_size, change FROM diff", _DIFF))
def j1(t: Tables):
    return reconcile.diff_listing(_previous(t), _listing(t)).select("file_key", "old_size", "new_size", "change")


def _supported(t: Tables):
    keyed = reconcile.with_file_key(_listing(t)).select("file_key", "extension")
    hits = identify.supported_only(keyed, t.formats).select("file_key", F.lit(True).alias("hit"))
    return keyed.join(hits, "file_key", "left").select(
        "file_key", F.coalesce("hit", F.lit(False)).alias("supported"), F.lit(False).alias("failed"))


@query("A4_scan_counters", with_ctes("formats", """SELECT count(*) FILTER (WHERE change <> 'unseen') AS discovered,
    count(*) FILTER (WHERE supported AND change IN ('added', 'changed')) AS processed,
    count(*) FILTER (WHERE change <> 'unseen' AND (NOT supported OR change = 'unchanged')) AS skipped,
    count(*) FILTER (WHERE supported AND change = 'added') AS added,
    count(*) FILTER (WHERE supported AND change = 'changed') AS changed,
    count(*) FILTER (WHERE change = 'unseen' AND old_status <> 'Missing' AND old_size % 3 = 0) AS missing,
    count(*) FILTER (WHERE supported AND change = 'unchanged') AS unchanged,
    count(*) FILTER (WHERE change <> 'unseen' AND NOT supported) AS unsupported, CAST(0 AS BIGINT) AS errors
    FROM flagged""", _DIFF))
def a4(t: Tables):
    # A third of the files known before lie where the run looked in full; the rest in a place not scanned, or not in full.
    place = F.expr("CASE size % 3 WHEN 0 THEN '/roms' WHEN 1 THEN '/away' ELSE '/half' END")
    before = _previous(t).withColumn("location", place).withColumn("last_seen", F.lit(BEFORE).cast("timestamp_ntz"))
    half = t.spark.createDataFrame([("/half", False)], "location string, complete boolean").withColumn(
        "started", F.lit(STARTED).cast("timestamp_ntz"))
    return reconcile.scan_counters(reconcile.diff_listing(before, _listing(t)), _supported(t), _runs(t).unionByName(half))


@query("A5_unsupported_histogram", r"""SELECT extension, count(*) AS files FROM (
    SELECT lower(regexp_extract(url, '(\.[^./\\]+)$', 1)) AS extension FROM pages) a
    WHERE extension <> '.html' GROUP BY extension""")
def a5(t: Tables):
    rows = t.pages.select(text.extension_of(F.col("url")).alias("extension"))
    known = t.formats.filter("format_position = 1").withColumn("extension", F.lit(".html"))
    return reconcile.unsupported_histogram(rows, known)


# All formats claim their extensions here; a third of the files has one that none claims.
@query("A5_listing_extensions", with_ctes("formats", """SELECT extension, count(*) AS files FROM (
    SELECT CASE WHEN order_key % 3 = 0 THEN '.hot' ELSE extension END AS extension FROM listing) a
    WHERE extension NOT IN (SELECT extension FROM formats) GROUP BY extension""", {"listing": _LISTING_SQL}))
def a5_listing(t: Tables):
    extension = F.when(F.col("order_key") % 3 == 0, ".HOT").otherwise(F.col("extension"))
    return reconcile.unsupported_histogram(_listing(t).select(extension.alias("extension")), t.formats)


def _full_previous(t: Tables):
    rows = _previous(t)
    blanks = {name: F.lit(None).cast("string") for name in
              ("system_key", "format_name", "region", "language", "revision", "version", "quick_hash", "reason",
               "catalog_source", "catalog_name")}
    return (rows.withColumns(blanks).withColumn("game_key", F.lit("old:game"))
            .withColumn("disc_number", F.lit(None).cast("int")).withColumn("track_number", F.lit(None).cast("int"))
            .withColumn("is_directory", F.lit(False)).withColumn("confidence", F.lit(0.5))
            .withColumn("catalog_verified_at", F.lit(None).cast("timestamp"))
            .withColumn("is_preferred", F.lit(True)).withColumn("preference_score", F.lit(7))
            .withColumn("is_detection_manual", F.lit(True)).withColumn("last_seen", F.lit(BEFORE).cast("timestamp_ntz")))


def _runs(t: Tables, complete: bool = True):
    return t.spark.createDataFrame([("/roms", complete)], "location string, complete boolean").withColumn(
        "started", F.lit(STARTED).cast("timestamp_ntz"))


def _scanned(t: Tables):
    fresh = reconcile.fresh_only(reconcile.with_file_key(_listing(t)), _previous(t))
    found = identify.identify_format(fresh, t.formats)
    parsed = resolve.parse_titles(found)
    rows = parsed.withColumn("file_group", F.lit(None).cast("string")).withColumn("quick_hash", F.lit("Q"))
    return (rows.withColumn("supported", F.col("system_key").isNotNull()).withColumn("failed", F.lit(False))
            .withColumn("is_directory", F.lit(False)))


_NEXT_SQL = f"""SELECT coalesce(p.file_key, upper(l.path)) AS file_key,
    CASE WHEN fresh THEN l.size ELSE p.size END AS size, CASE WHEN fresh THEN l.modified ELSE p.modified END AS modified,
    CASE WHEN fresh THEN 'Normal' WHEN l.path IS NULL THEN 'Missing' WHEN p.status = 'Missing' THEN 'Normal'
         ELSE p.status END AS status,
    CASE WHEN fresh THEN 'Unknown' ELSE p.catalog_status END AS catalog_status, p.file_group,
    coalesce(p.is_excluded, false) AS is_excluded, coalesce(p.is_manual, false) AS is_manual, NOT fresh AS is_preferred,
    CASE WHEN fresh THEN 0 ELSE 7 END AS preference_score, NOT fresh AS is_detection_manual,
    CASE WHEN l.path IS NULL THEN TIMESTAMP '{BEFORE}' ELSE TIMESTAMP '{STARTED}' END AS last_seen
    FROM (SELECT p, l, l.path IS NOT NULL AND l.extension IN (SELECT extension FROM formats)
            AND NOT coalesce(p.size = l.size AND p.modified = l.modified, false) AS fresh
          FROM previous p FULL JOIN listing l ON upper(l.path) = p.file_key) j
    WHERE p.path IS NOT NULL OR fresh"""
_NEXT_COLUMNS = ["file_key", "size", "modified", "status", "catalog_status", "file_group", "is_excluded", "is_manual",
                 "is_preferred", "preference_score", "is_detection_manual", "last_seen"]


@query("U1_apply_changed_files", with_ctes("formats", _NEXT_SQL, _CTES))
def u1(t: Tables):
    return reconcile.apply_scan(_full_previous(t), _scanned(t), _runs(t)).select(_NEXT_COLUMNS)


@query("U2_touch_unchanged", with_ctes("", f"""SELECT p.file_key,
    CASE WHEN l.path IS NOT NULL AND p.status = 'Missing' THEN 'Normal' ELSE p.status END AS status,
    CASE WHEN l.path IS NOT NULL THEN TIMESTAMP '{STARTED}' ELSE TIMESTAMP '{BEFORE}' END AS last_seen
    FROM previous p LEFT JOIN listing l ON upper(l.path) = p.file_key AND l.size = p.size AND l.modified = p.modified""",
    _CTES))
def u2(t: Tables):
    seen = reconcile.diff_listing(_previous(t), _listing(t)).filter("change = 'unchanged'")
    return reconcile.touch_unchanged(_full_previous(t), seen, F.lit(STARTED).cast("timestamp_ntz")).select(
        "file_key", "status", "last_seen")


@query("U3_mark_missing", with_ctes("files", """SELECT file_key, CASE WHEN modified < TIMESTAMP '1998-06-01 00:00:00'
    AND location <> '/shelf4' THEN 'Missing' ELSE status END AS status FROM files"""))
def u3(t: Tables):
    health = _health(t).withColumn("started", F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))
    return reconcile.mark_missing(t.files.withColumn("last_seen", F.col("modified")), health).select("file_key", "status")


def _health(t: Tables):
    """Runs over the shelves; the corrupt files of one shelf could not be read."""
    runs = t.files.select("location").distinct()
    errors = t.files.filter("status = 'Corrupt' and location = '/shelf4'").select("location", "path")
    return reconcile.listing_health(runs, errors)


@query("S3_listing_health", with_ctes("files", """SELECT location,
    count(*) FILTER (WHERE status = 'Corrupt' AND location = '/shelf4') AS error_count,
    count(*) FILTER (WHERE status = 'Corrupt' AND location = '/shelf4') = 0 AS complete FROM files GROUP BY location"""))
def s3(t: Tables):
    return _health(t)


@query("U17_remove_location", with_ctes("files games", """SELECT f.file_key, h.hash, g.title FROM files f
    JOIN games g ON g.game_key = f.game_key JOIN (SELECT file_key, md5(path) AS hash FROM files) h
    ON h.file_key = f.file_key WHERE f.location <> '/shelf7'"""))
def u17(t: Tables):
    hashes = t.files.select("file_key", F.md5("path").alias("hash"))
    files, kept, games = reconcile.remove_location(t.files, hashes, t.games, "/shelf7")
    return (files.select("file_key", "game_key").join(kept, "file_key")
            .join(games.select("game_key", "title"), "game_key").select("file_key", "hash", "title"))


# Clicks begin a run of a user's location and purchases end it.
@query("U18_interrupted_runs", """SELECT user_id, last_started, last_completed, runs FROM (
    SELECT user_id, max(ts) FILTER (WHERE event_type = 'click') AS last_started,
      max(ts) FILTER (WHERE event_type = 'purchase') AS last_completed,
      count(*) FILTER (WHERE event_type = 'purchase') AS runs, max(value) > 5 AS enabled FROM events GROUP BY user_id) a
    WHERE enabled AND last_started IS NOT NULL AND (last_completed IS NULL OR last_started > last_completed)""")
def u18(t: Tables):
    users = t.events.groupBy(F.col("user_id").alias("location")).agg((F.max("value") > 5).alias("enabled"))
    empty = users.withColumns({"last_started": F.lit(None).cast("timestamp_ntz"),
                               "last_completed": F.lit(None).cast("timestamp_ntz"), "file_count": F.lit(None).cast("long")})
    starts = (t.events.filter("event_type = 'click'").groupBy(F.col("user_id").alias("location"))
              .agg(F.max("ts").alias("started")))
    ends = (t.events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("location"))
            .agg(F.max("ts").alias("completed"), F.count("*").alias("file_count"), F.lit(None).cast("timestamp_ntz").alias("started")))
    begun = reconcile.begin_runs(empty, starts)
    done = reconcile.complete_runs(begun, ends)
    return reconcile.interrupted_runs(done).select(
        F.col("location").alias("user_id"), "last_started", "last_completed", F.coalesce("file_count", F.lit(0).cast("long")).alias("runs"))


# --- sources -------------------------------------------------------------------------

@query("S1_list_files", """SELECT lang, source, CAST(sum(strlen(replace(text, chr(10), ' ')) + 1) AS BIGINT) AS size,
    '.txt' AS extension FROM documents GROUP BY lang, source""")
def s1(t: Tables):
    root = scratch_path(t.spark, "listing")
    (t.documents.select("lang", "source", F.translate("text", "\n", " ").alias("value"))
     .write.partitionBy("lang", "source").text(root))
    # Spark's own marks and checksums lie beside the texts.
    rows = disk.list_files(t.spark, root).filter("extension = '.txt'")
    return (rows.groupBy(F.regexp_extract("path", r"lang=([^/]*)/", 1).alias("lang"),
                         F.regexp_extract("path", r"source=([^/]*)/", 1).alias("source"))
            .agg(F.sum("size").alias("size"), F.min("extension").alias("extension")))


def _write_tree(documents, root: str, body: str, unreadable: str = "false", gone: str = "false"):
    """Documents as files ``root/source/NES/<doc_id % 7>/Doc <doc_id> (USA).nes``, written in the tasks; returns how many rows were dealt with.

    ``unreadable`` rows become links to themselves, which nothing can open; ``gone`` ones are removed; a null body leaves a file as it is.
    """
    root = local_path(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, source, text_body, loop, drop in batch.itertuples(index=False):
                folder = os.path.join(root, source, "NES", str(doc % 7))
                os.makedirs(folder, exist_ok=True)
                path = os.path.join(folder, f"Doc {doc} (USA).nes")
                if loop and not os.path.islink(path):
                    os.symlink(path, path)
                elif drop and os.path.exists(path):
                    os.remove(path)
                elif not loop and not drop and text_body is not None:
                    with open(path, "wb") as stream:
                        stream.write(text_body.encode())
            yield pd.DataFrame({"rows": [len(batch)]})

    rows = documents.select("doc_id", "source", F.expr(body).alias("body"), F.expr(unreadable).alias("unreadable"), F.expr(gone).alias("gone"))
    return rows.mapInPandas(write, "rows long").agg(F.sum("rows")).first()[0]


def _tree_locations(documents, root: str):
    return documents.select(F.concat(F.lit(f"{root}/"), "source").alias("location")).distinct().withColumn("recursive", F.lit(True))


# Documents below one folder per source; every tenth cannot be read, and one location is not there.
@query("S3_unreadable_paths", """SELECT source AS location, count(*) FILTER (WHERE doc_id % 10 <> 0) AS files,
    CAST(coalesce(sum(strlen(text)) FILTER (WHERE doc_id % 10 <> 0), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE doc_id % 10 = 0) AS error_count,
    count(*) FILTER (WHERE doc_id % 10 = 0) = 0 AS complete FROM documents GROUP BY source
    UNION ALL SELECT 'nowhere', 0, 0, 1, false""")
def s3_unreadable(t: Tables):
    root = scratch_path(t.spark, "tree")
    _write_tree(t.documents, root, "text", unreadable="doc_id % 10 = 0")
    nowhere = t.spark.createDataFrame([(f"{root}/nowhere", True)], "location string, recursive boolean")
    locations = _tree_locations(t.documents, root).unionByName(nowhere)
    found = tree.list_trees(locations)
    sums = found.files.groupBy("location").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    zero = F.lit(0).cast("long")
    return (reconcile.listing_health(locations.select("location"), found.problems).join(sums, "location", "left")
            .select(F.substring_index("location", "/", -1).alias("location"), F.coalesce("files", zero).alias("files"),
                    F.coalesce("bytes", zero).alias("bytes"), "error_count", "complete"))


def _scan_tree(t: Tables, library: scan_job.Library, root: str, started: str) -> scan_job.Library:
    locations = _tree_locations(t.documents, root)
    found = tree.list_trees(locations)
    runs = reconcile.listing_health(locations.select("location"), found.problems).withColumn("started", F.lit(started).cast("timestamp"))
    return scan_job.scan(library, reconcile.collapse_packages(found.files), t.formats, runs)[0]


# Two whole scans of a tree of documents. Between them some files change, some vanish, some come; one source cannot be read in full.
_COPY, _NEW, _CHANGED, _GONE = "doc_id % 13 = 0", "doc_id % 5 = 4", "doc_id % 6 = 1", "doc_id % 11 = 3"
_BODY = f"CASE WHEN {_COPY} THEN 'one text' ELSE concat(doc_id, ' ', text) END"


@query("U1_whole_scan", f"""WITH d AS (SELECT doc_id, source, {_COPY} AS copy, NOT {_COPY} AND {_NEW} AS new, NOT {_COPY} AND {_CHANGED} AS changed,
        NOT {_COPY} AND NOT {_NEW} AND {_GONE} AS gone, strlen(text) + length(CAST(doc_id AS VARCHAR)) + 1 AS bytes,
        source = (SELECT min(source) FROM documents) AS unreadable FROM documents)
    SELECT 'Doc ' || CAST(doc_id AS VARCHAR) || ' (USA).nes' AS file_name, CASE WHEN copy THEN 8 WHEN changed AND NOT gone THEN bytes + 1 ELSE bytes END AS size,
      CASE WHEN copy AND (SELECT count(*) FROM d WHERE copy) > 1 THEN 'Duplicate' WHEN gone AND NOT unreadable THEN 'Missing' ELSE 'Normal' END AS status,
      'NES' AS system_key, 'NES:doc' || CAST(doc_id AS VARCHAR) AS game_key, 'Doc ' || CAST(doc_id AS VARCHAR) AS title, NOT (gone AND NOT unreadable) AS is_preferred,
      CASE WHEN copy AND (SELECT count(*) FROM d WHERE copy) > 1 THEN upper(sha256('one text')) END AS sha256,
      CASE WHEN gone THEN 2030 ELSE 2031 END AS seen FROM d""")
def u1_whole(t: Tables):
    root = scratch_path(t.spark, "tree")
    documents = t.documents
    first = documents.select(F.min("source").alias("first"))
    _write_tree(documents.filter(f"({_COPY}) OR NOT ({_NEW})"), root, _BODY)
    library = _scan_tree(t, scan_job.empty_library(t.spark), root, "2030-01-01")
    # The second state of the tree; a file that nothing can read appears in the first source.
    changes = f"CASE WHEN NOT ({_COPY}) AND ({_CHANGED}) THEN concat({_BODY}, '!') WHEN NOT ({_COPY}) AND ({_NEW}) THEN {_BODY} END"
    _write_tree(documents, root, changes, gone=f"NOT ({_COPY}) AND NOT ({_NEW}) AND ({_GONE})")
    _write_tree(first.select(F.lit(-1).alias("doc_id"), F.col("first").alias("source")), root, "CAST(NULL AS STRING)", unreadable="true")
    library = _scan_tree(t, library, root, "2031-01-01")
    sums = library.hashes.filter("algorithm = 'SHA256'").select("file_key", F.col("hash").alias("sha256"))
    titles = library.games.select("game_key", "title")
    return (library.files.join(sums, "file_key", "left").join(titles, "game_key")
            .select("file_name", "size", "status", "system_key", "game_key", "title", "is_preferred", "sha256", F.year("last_seen").alias("seen")))


# Orders as folders: filled ones carry the marker at their root, open ones in the subfolder.
PACKAGE_LISTING = """
SELECT '/pkg/' || CAST(l_orderkey AS STRING) || '/' || CASE WHEN l_linenumber > 3 THEN 'USRDIR/data/' ELSE 'PS3_GAME/' END
    || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '.bin' AS path,
  CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '.bin' AS file_name,
  '.bin' AS extension, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_shipdate AS modified, '/pkg' AS location
FROM {lineitem}
UNION ALL
SELECT '/pkg/' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '/PS3_GAME' END || '/PARAM.SFO',
  'PARAM.SFO', '.sfo', o_custkey, o_orderdate, '/pkg' FROM {orders} WHERE o_orderstatus <> 'P'
"""
_PACKAGES_SQL = {"entries": PACKAGE_LISTING.replace("{lineitem}", "lineitem").replace("{orders}", "orders"),
                 "owned": r"""SELECT e.*, regexp_extract(path, '^/pkg/\d+') AS package,
                    o.o_orderstatus <> 'P' AS inside FROM entries e
                    JOIN orders o ON '/pkg/' || CAST(o.o_orderkey AS STRING) = regexp_extract(path, '^/pkg/\d+')"""}


def _packages(t: Tables):
    return reconcile.collapse_packages(
        t.spark.sql(PACKAGE_LISTING, lineitem=t.lineitem, orders=t.orders)
        .withColumn("created", F.lit(None).cast("timestamp")))


@query("S2_collapse_packages", with_ctes("", """SELECT path, extension, size, modified, false AS is_directory,
    CAST(NULL AS STRING) AS marker_path FROM owned WHERE NOT inside UNION ALL
    SELECT package, '.ps3dir', CAST(sum(size) AS BIGINT), max(modified), true, max(path) FILTER (WHERE file_name = 'PARAM.SFO')
    FROM owned WHERE inside GROUP BY package""", _PACKAGES_SQL))
def s2(t: Tables):
    return _packages(t).select("path", "extension", "size", "modified", "is_directory", "marker_path")


@query("A12_package_rollup", with_ctes("", """SELECT package, CAST(sum(size) AS BIGINT) AS size, max(modified) AS modified
    FROM owned WHERE inside GROUP BY package""", _PACKAGES_SQL))
def a12(t: Tables):
    return _packages(t).filter("is_directory").select(F.col("path").alias("package"), "size", "modified")


# One JSON file of systems per brand, with the part types as formats.
@query("S4_load_systems", """SELECT p_brand AS system_key, 'Maker ' || p_brand AS system_name,
    '.' || lower(p_type) AS extension, 'Kind ' || p_type AS format_name, min(p_size) AS priority,
    bool_or(p_size = 50) AS is_archive, false AS is_multi_file FROM part GROUP BY p_brand, p_type""")
def s4(t: Tables):
    kinds = t.part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("low"), F.bool_or(F.col("p_size") == 50).alias("big"))
    formats = F.collect_list(F.struct(F.upper("p_type").alias("extension"), F.concat(F.lit("Kind "), "p_type").alias("formatName"),
                                      F.col("low").alias("priority"), F.col("big").alias("isArchive")))
    texts = kinds.groupBy("p_brand").agg(F.to_json(F.array(F.struct(
        F.col("p_brand").alias("key"), F.concat(F.lit("Maker "), F.col("p_brand")).alias("name"), formats.alias("formats")))).alias("value"))
    path = scratch_path(t.spark, "systems")
    texts.select("value").repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(path)
    return catalogs.load_systems(t.spark, path).select(
        "system_key", "system_name", "extension", "format_name", "priority", "is_archive", "is_multi_file")


@query("S5_ingest_catalog_xml", """SELECT p_name AS name,
    CASE WHEN p_size % 5 = 0 THEN p_name ELSE 'rom ' || CAST(p_partkey AS STRING) END AS rom_name,
    CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_partkey * 16 END AS size,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE upper(sha1(CAST(p_partkey AS STRING))) END AS sha1,
    upper(md5(p_name)) AS md5 FROM part""")
def s5(t: Tables):
    """Catalog XML with all three row tags, nested and flat, written and read back."""
    rom = """concat('<', tag, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(' name="rom ', p_partkey, '"') END,
        ' size="', CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE cast(p_partkey * 16 AS string) END, '" md5=" ', md5(p_name),
        '" sha1="', CASE WHEN p_size % 3 = 0 THEN ' ' ELSE sha1(cast(p_partkey AS string)) END, '"/>')"""
    line = f"""CASE p_size % 4 WHEN 0 THEN concat('<game name="', p_name, '">', {rom}, '</game>')
        WHEN 1 THEN concat('<machine><description>', p_name, '</description>', {rom}, '</machine>')
        WHEN 2 THEN concat('<software name="', p_name, '"><part><dataarea>', {rom}, '</dataarea></part></software>')
        ELSE concat('<software name="', p_name, '"><part><diskarea>', {rom}, '</diskarea></part></software>') END"""
    rows = t.part.withColumn("tag", F.expr("CASE WHEN p_size % 4 = 3 THEN 'disk' ELSE 'rom' END"))
    # One well-formed file per 500 keys, so no file or group grows with the table.
    files = (rows.select(F.floor(F.col("p_partkey") / 500).alias("chunk"), F.expr(line).alias("line"))
             .groupBy("chunk").agg(F.array_join(F.collect_list("line"), " ").alias("body")))
    path = scratch_path(t.spark, "catalog-xml")
    (files.select(F.concat(F.lit('<?xml version="1.0"?><datafile>'), "body", F.lit("</datafile>")).alias("value"))
     .write.option("maxRecordsPerFile", 1).text(path))
    return catalogs.read_catalog_xml(t.spark, path).select("name", "rom_name", "size", "sha1", "md5")


# The same element directly in its game, in an unknown one, and four levels down in one of another namespace, with signs that XML escapes.
@query("S5_catalog_at_any_depth", """SELECT 'Game & ' || p_name AS name, depth, p_type || CASE depth WHEN 2 THEN ' > "x" <' ELSE '' END AS rom_name,
    p_partkey + depth AS size, '00' || upper(md5(p_name)) AS md5 FROM part, (SELECT unnest([0, 1, 2]) AS depth) d""")
def s5_depths(t: Tables):
    def rom(tag: str, depth: int, more: str = "") -> str:
        return f"""concat('<{tag} name="', p_type, '{more}" md5="00', md5(p_name), '" size="', p_partkey + {depth}, '" crc="{depth}"/>')"""
    line = f"""concat('<software name="Game &amp; ', p_name, '">', {rom('disk', 0)}, '<note rom="no"><!-- rom > -->', {rom('rom', 1)}, '</note>',
        '<a><b><c xmlns:q="u"><q:part>', {rom('q:rom', 2, ' &gt; &quot;x&quot; &lt;')}, '</q:part></c></b></a></software>')"""
    files = (t.part.select(F.floor(F.col("p_partkey") / 500).alias("chunk"), F.expr(line).alias("line"))
             .groupBy("chunk").agg(F.array_join(F.collect_list("line"), " ").alias("body")))
    path = scratch_path(t.spark, "catalog-xml")
    (files.select(F.concat(F.lit('<?xml version="1.0"?><datafile>'), "body", F.lit("</datafile>")).alias("value"))
     .write.option("maxRecordsPerFile", 1).text(path))
    found = catalogs.read_catalog_xml(t.spark, path)
    return found.select("name", F.col("crc32").cast("int").alias("depth"), "rom_name", "size", "md5")


@query("S6_ingest_catalog_text", """SELECT CAST(p_partkey AS STRING) || '.dat' AS source_file, position,
    p_name || ' "' || p_type || '"' AS name, p_brand || CASE position WHEN 0 THEN '' ELSE '-b' END AS rom_name,
    CASE position WHEN 0 THEN p_partkey ELSE 0 END AS size,
    CASE position WHEN 0 THEN upper(sha1(p_name)) END AS sha1, CASE position WHEN 1 THEN upper(md5(p_name)) END AS md5
    FROM part, (SELECT unnest([0, 1]) AS position) u""")
def s6(t: Tables):
    body = r"""concat('clrmamepro ( name "x" )\n', CASE WHEN p_size % 2 = 0 THEN 'game' ELSE 'machine' END,
        ' (\n name "', p_name, ' \\"', p_type, '\\""\n rom ( name "', p_brand, '" size ', p_partkey, ' SHA1 ', sha1(p_name),
        ' )\n note ( rom ( name no ) )\n disk ( name "gone" Name "', p_brand, '-b" size none md5 ', md5(p_name), ' )\n)')"""
    texts = t.part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".dat")).alias("source_file"),
                          F.expr(body).alias("value"))
    return catalogs.parse_catalog_text(texts).select("source_file", "position", "name", "rom_name", "size", "sha1", "md5")


# One catalog file with a game per part and brackets, quotes and line breaks in its texts, read in small chunks.
@query("S6_catalog_in_chunks", """SELECT 'all.dat' AS source_file, 2 * (row_number() OVER (ORDER BY p_partkey) - 1) + n AS position,
    p_name || ' (' || p_type || ') "' || p_brand || '"' AS name, CASE n WHEN 0 THEN p_brand || ' )' ELSE p_name || ' (' || p_type || ') "' || p_brand || '"' END AS rom_name,
    CASE n WHEN 0 THEN p_partkey ELSE 0 END AS size, CASE n WHEN 1 THEN upper(sha1(p_name)) END AS sha1
    FROM (SELECT *, 0 AS n FROM part) a WHERE n = 0 UNION ALL
    SELECT 'all.dat', 2 * (row_number() OVER (ORDER BY p_partkey) - 1) + 1, p_name || ' (' || p_type || ') "' || p_brand || '"',
    p_name || ' (' || p_type || ') "' || p_brand || '"', 0, upper(sha1(p_name)) FROM part""")
def s6_chunks(t: Tables):
    body = r"""concat('game (\n rom ( name "', p_brand, ' )" size ', p_partkey, ' )\n note ( rom ( name no ) )\n name "', p_name, ' (', p_type, ') \\"', p_brand,
        '\\""\n disk ( size none sha1 ', sha1(p_name), ' )\n)')"""
    path = scratch_path(t.spark, "catalog")
    # One file on purpose, in order of the parts.
    lines = t.part.select("p_partkey", F.expr(body).alias("value")).coalesce(1).sortWithinPartitions("p_partkey").select("value")
    lines.write.text(path)
    found = catalogs.read_catalog_text(t.spark, path, chunk=2000)
    return found.select(F.lit("all.dat").alias("source_file"), "position", "name", "rom_name", "size", "sha1")


def zipped_documents(t: Tables):
    """Every document as a zip of its text and its source name; derived by Spark, one archive per row."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for doc, body, source in zip(batch["doc_id"], batch["text"], batch["source"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.mkdir("notes")
                    archive.writestr(f"notes/{source}.txt", source)
                    archive.writestr(f"{doc}.nes", body)
                packed.append(buffer.getvalue())
            yield pd.DataFrame({"path": batch["doc_id"].astype(str) + ".zip", "content": packed})

    return t.documents.select("doc_id", "text", "source").mapInPandas(pack, "path string, content binary")


@query("S7_list_archive_entries", """SELECT CAST(doc_id AS STRING) || '.zip' AS archive_path, 0 AS position,
    'notes/' || source || '.txt' AS entry_name, strlen(source) AS entry_size FROM documents UNION ALL
    SELECT CAST(doc_id AS STRING) || '.zip', 1, CAST(doc_id AS STRING) || '.nes', strlen(text) FROM documents""")
def s7(t: Tables):
    return disk.list_archive_entries(zipped_documents(t))


@query("S8_extract_package_titles", """SELECT CAST(p_partkey AS STRING) AS marker_path,
    CASE WHEN p_size % 10 IN (1, 2, 3) THEN NULL ELSE p_name || ' é' END AS package_title FROM part""")
def s8(t: Tables):
    """Package metadata built from part names: whole, without title, wrong magic, and cut short."""
    def little(value: str, width: int) -> str:
        text_hex = f"lpad(hex({value}), {2 * width}, '0')"
        return "concat(" + ", ".join(f"substring({text_hex}, {2 * (width - n) - 1}, 2)" for n in range(width)) + ")"
    title = "hex(encode(concat('  ', p_name, ' é ', '\\0'), 'UTF-8'))"
    length = f"length({title}) div 2"
    key = "CASE WHEN p_size % 10 = 1 THEN 'SUBTI' ELSE 'TITLE' END"
    whole = f"""concat(CASE WHEN p_size % 10 = 2 THEN '00505347' ELSE '00505346' END, '01010000', {little('52L', 4)}, {little('68L', 4)},
        {little('2L', 4)}, {little('0L', 2)}, {little('1028L', 2)}, {little('4L', 4)}, {little('4L', 4)}, {little('0L', 4)},
        {little('8L', 2)}, {little('516L', 2)}, {little(length, 4)}, {little('128L', 4)}, {little('4L', 4)},
        hex('TITLE_ID'), hex({key}), '000000', '41414100', {title})"""
    rows = t.part.select(F.col("p_partkey").cast("string").alias("path"), F.expr(
        f"unhex(CASE WHEN p_size % 10 = 3 THEN substring({whole}, 1, 60) ELSE {whole} END)").alias("content"))
    return disk.package_titles(rows)


# --- dimensions ------------------------------------------------------------------------

@query("U16_sync_systems", """SELECT coalesce(b.n_name, a.c_key) AS system_key,
    CASE WHEN b.n_name IS NOT NULL THEN 'Nation ' || b.n_name ELSE a.c_key END AS system_name,
    coalesce(a.enabled, true) AS enabled FROM
    (SELECT DISTINCT 'NATION_' || CAST(c_nationkey + 5 AS STRING) AS c_key, c_nationkey % 2 = 0 AS enabled FROM customer) a
    FULL JOIN nation b ON b.n_name = a.c_key""")
def u16(t: Tables):
    current = t.customer.selectExpr("'NATION_' || CAST(c_nationkey + 5 AS STRING) AS system_key",
                                    "c_nationkey % 2 = 0 AS enabled").distinct()
    current = current.withColumns({"system_name": F.col("system_key"), "manufacturer": F.lit("m"), "category": F.lit("c")})
    incoming = t.nation.select(F.col("n_name").alias("system_key"), F.concat(F.lit("Nation "), "n_name").alias("system_name"),
                               F.lit("n").alias("manufacturer"), F.lit("d").alias("category"), F.lit(True).alias("enabled"))
    return curation.sync_systems(current, incoming).select("system_key", "system_name", "enabled")


@query("U16_sync_formats", """SELECT coalesce(b.p_brand, a.p_brand) AS system_key, coalesce(b.p_type, a.p_type) AS extension,
    coalesce(b.p_name, a.p_name) AS format_name, coalesce(b.priority, a.priority) AS priority FROM
    (SELECT p_brand, p_type, p_name, max(p_size) AS priority FROM part WHERE p_size < 30 GROUP BY ALL) a FULL JOIN
    (SELECT p_brand, p_type, p_name, min(p_size) + 100 AS priority FROM part WHERE p_size > 20 GROUP BY ALL) b
    ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name = b.p_name""")
def u16_formats(t: Tables):
    def side(condition: str, priority):
        return (t.part.filter(condition).groupBy(F.col("p_brand").alias("system_key"), F.col("p_type").alias("extension"),
                                                 F.col("p_name").alias("format_name")).agg(priority.alias("priority"))
                .withColumns({"format_type": F.lit("Rom"), "requires_header_check": F.lit(False),
                              "is_archive": F.lit(False), "is_multi_file": F.lit(False)}))
    merged = curation.sync_formats(side("p_size < 30", F.max("p_size")), side("p_size > 20", F.min("p_size") + 100))
    return merged.select("system_key", "extension", "format_name", "priority")
