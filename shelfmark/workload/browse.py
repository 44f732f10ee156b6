"""Views, summaries, counts, pages, reports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import artwork_key
from shelfmark.operators import duplicates, paging, preference, reconcile, views
from shelfmark.sources import sinks
from shelfmark.session import scratch_path
from shelfmark.workload.base import Tables, query, with_ctes

GAME_COLUMNS = ["game_key", "system_key", "title", "sort_title", "is_wanted"]
_G = ", ".join(f"g.{name}" for name in GAME_COLUMNS)


def _exists(condition: str) -> str:
    return with_ctes("files games", f"SELECT {_G} FROM games g WHERE EXISTS "
                     f"(SELECT 1 FROM files f WHERE f.game_key = g.game_key AND {condition})")


def _like_both(term: str) -> str:
    return with_ctes("files games", f"""SELECT {_G} FROM games g WHERE lower(title) LIKE '%{term}%' OR EXISTS (
        SELECT 1 FROM files f WHERE f.game_key = g.game_key
        AND (lower(f.file_name) LIKE '%{term}%' OR lower(f.path) LIKE '%{term}%'))""")


@query("F2_search_games", _like_both("2_6 [b1]-"))
def f2(t: Tables):
    return views.search_games(t.games, t.files, "  2_6 [B1]- ").select(GAME_COLUMNS)


@query("F2_search_pages", """
SELECT page_id, url FROM pages WHERE lower(url) LIKE '%.example.org/%_=%' OR lower(html) LIKE '%.example.org/%_=%'""")
def f2_pages(t: Tables):
    pages = t.pages.select(F.col("page_id").alias("game_key"), F.col("url").alias("title"), "html")
    bodies = pages.select("game_key", F.col("html").alias("file_name"), F.col("title").alias("path"))
    return (views.search_games(pages, bodies, ".EXAMPLE.org/%_=")
            .select(F.col("game_key").alias("page_id"), F.col("title").alias("url")))


@query("F3_filter_system", with_ctes("games", f"SELECT {_G} FROM games g WHERE system_key = 'SNES'"))
def f3(t: Tables):
    return views.filter_system(t.games, "SNES").select(GAME_COLUMNS)


@query("F4_view_all", with_ctes("games", f"SELECT {_G} FROM games g"))
def f4(t: Tables):
    return views.view_games(t.games, t.files, "All").select(GAME_COLUMNS)


@query("F5_view_verified", _exists("f.catalog_status = 'Verified'"))
def f5(t: Tables):
    return views.view_games(t.games, t.files, "Verified").select(GAME_COLUMNS)


@query("F6_view_unverified", _exists("f.status <> 'Missing' AND f.catalog_status <> 'Verified'"))
def f6(t: Tables):
    return views.view_games(t.games, t.files, "Unverified").select(GAME_COLUMNS)


@query("F7_view_exact_duplicates", _exists("f.status = 'Duplicate'"))
def f7(t: Tables):
    return views.view_games(t.games, t.files, "ExactDuplicates").select(GAME_COLUMNS)


@query("F8_view_multiple_versions", with_ctes("files games", f"""SELECT {_G} FROM games g WHERE (
    SELECT count(*) FROM files f WHERE f.game_key = g.game_key AND f.status <> 'Missing') > 1"""))
def f8(t: Tables):
    return views.view_games(t.games, t.files, "MultipleVersions").select(GAME_COLUMNS)


@query("F9_view_missing", _exists("f.status = 'Missing'"))
def f9(t: Tables):
    return views.view_games(t.games, t.files, "Missing").select(GAME_COLUMNS)


@query("F10_view_needs_review",
       _exists("(f.confidence < 0.75 OR f.catalog_status IN ('NoMatch', 'Error', 'Unsupported'))"))
def f10(t: Tables):
    return views.view_games(t.games, t.files, "NeedsReview").select(GAME_COLUMNS)


@query("F11_view_preferred", _exists("f.is_preferred"))
def f11(t: Tables):
    return views.view_games(t.games, t.files, "PreferredCopies").select(GAME_COLUMNS)


@query("F12_view_wanted", with_ctes("games", f"SELECT {_G} FROM games g WHERE is_wanted"))
def f12(t: Tables):
    return views.view_games(t.games, t.files, "Wanted").select(GAME_COLUMNS)


# --- summaries and counts ----------------------------------------------------

_SUMMARY_CTE = {
    "figures": """SELECT game_key, count(*) AS file_count,
      count(*) FILTER (WHERE status = 'Duplicate') AS duplicate_count,
      count(*) FILTER (WHERE catalog_status = 'Verified') AS verified_count,
      count(*) FILTER (WHERE status = 'Missing') AS missing_count,
      CAST(sum(size) FILTER (WHERE status <> 'Missing') AS BIGINT) AS total_size FROM files GROUP BY game_key""",
    "first_preferred": """SELECT game_key, catalog_name FROM (SELECT game_key, catalog_name,
      row_number() OVER (PARTITION BY game_key ORDER BY file_key) AS n FROM files
      WHERE is_preferred) x WHERE n = 1""",
    "first_region": """SELECT game_key, region FROM (SELECT game_key, region,
      row_number() OVER (PARTITION BY game_key ORDER BY is_preferred DESC, file_key) AS n FROM files) x WHERE n = 1""",
    "summary": """SELECT g.game_key, g.title, s.system_name, g.system_key,
      coalesce(c.file_count, 0) AS file_count, coalesce(c.duplicate_count, 0) AS duplicate_count,
      coalesce(c.verified_count, 0) AS verified_count,
      CASE WHEN coalesce(c.missing_count, 0) > 0 THEN 'Missing' WHEN coalesce(c.duplicate_count, 0) > 0
        THEN 'Duplicate' ELSE 'Normal' END AS worst_status,
      p.catalog_name AS preferred_catalog_name, r.region AS preferred_region,
      coalesce(c.total_size, 0) AS total_size, g.is_wanted, g.sort_title
      FROM games g JOIN systems s ON s.system_key = g.system_key LEFT JOIN figures c ON c.game_key = g.game_key
      LEFT JOIN first_preferred p ON p.game_key = g.game_key LEFT JOIN first_region r ON r.game_key = g.game_key""",
}


def _summary(body: str) -> str:
    return with_ctes("files games systems", body, _SUMMARY_CTE)


@query("A1_game_summary", _summary("SELECT * EXCLUDE (sort_title) FROM summary"))
def a1(t: Tables):
    return views.game_summary(t.games, t.files, t.systems)


@query("A2_library_counts", with_ctes("files games", """SELECT (SELECT count(*) FROM games) AS games,
    count(*) AS files, count(*) FILTER (WHERE status = 'Duplicate') AS duplicates,
    count(*) FILTER (WHERE status = 'Missing') AS missing,
    count(*) FILTER (WHERE catalog_status = 'Verified') AS verified FROM files"""))
def a2(t: Tables):
    return views.library_counts(t.games, t.files)


@query("A3_games_per_system", with_ctes("games", """SELECT system_key, count(*) AS games FROM games
    GROUP BY ROLLUP (system_key)"""))
def a3(t: Tables):
    return views.games_per_system(t.games)


# --- pages -------------------------------------------------------------------

@query("P1_page_games", _summary("""SELECT * EXCLUDE (sort_title, n), n - 250 AS position,
    (SELECT count(*) FROM summary WHERE is_wanted) > 750 AS has_more
    FROM (SELECT *, row_number() OVER (ORDER BY sort_title, game_key) AS n FROM summary WHERE is_wanted) x
    WHERE n > 250 AND n <= 750"""))
def p1(t: Tables):
    page = views.page_games(t.games, t.files, t.systems, 250, 500, view="Wanted")
    return page.withColumn("position", F.col("position").cast("long"))


@query("P1_page_of_index", _summary("""SELECT * EXCLUDE (sort_title, n), n - 10000 AS position,
    (SELECT count(*) FROM summary) > 10500 AS has_more
    FROM (SELECT *, row_number() OVER (ORDER BY sort_title, game_key) AS n FROM summary) x
    WHERE n > 10000 AND n <= 10500"""))
def p1_index(t: Tables):
    page = paging.index_page(paging.page_index(t.games, t.files), t.files, t.systems, 10_000, 500)
    return page.withColumn("position", F.col("position").cast("long"))


@query("P2_search_unbounded", _summary("""SELECT * FROM summary
    WHERE worst_status = 'Missing' AND (lower(title) LIKE '%high%' OR game_key IN (
        SELECT game_key FROM files WHERE lower(file_name) LIKE '%high%' OR lower(path) LIKE '%high%'))"""))
def p2(t: Tables):
    found = views.search_games(t.games, t.files, "HIGH")
    return views.search_unbounded(found, t.files, t.systems, view="Missing")


@query("P3_list_systems", with_ctes("games systems", """SELECT s.system_key, s.system_name, s.manufacturer, s.category,
    count(*) AS games FROM systems s JOIN games g ON g.system_key = s.system_key WHERE s.enabled
    GROUP BY ALL ORDER BY s.system_name"""))
def p3(t: Tables):
    used = t.games.groupBy("system_key").agg(F.count("*").alias("games"))
    rows = t.systems.filter("enabled").join(used, "system_key")
    return views.list_systems(rows).select("system_key", "system_name", "manufacturer", "category", "games")


@query("P3_list_locations", with_ctes("files", """SELECT location, count(*) AS files, min(modified) AS oldest
    FROM files GROUP BY location ORDER BY location"""))
def p3_locations(t: Tables):
    roots = t.files.groupBy("location").agg(F.count("*").alias("files"), F.min("modified").alias("oldest"))
    return views.list_locations(roots.withColumn("enabled", F.lit(True)), enabled_only=True).drop("enabled")


# --- report rows -------------------------------------------------------------

# Stored hashes of the files: half carry a SHA-256, a third a SHA-1.
_HASHES_SQL = """SELECT file_key, 'SHA256' AS algorithm, sha256(CAST(size AS STRING)) AS hash FROM files
      WHERE status <> 'Missing' UNION ALL
    SELECT file_key, 'SHA1', sha1(path) FROM files WHERE catalog_status = 'Verified'"""


def stored_hashes(t: Tables):
    sha256 = t.files.filter("status <> 'Missing'").select(
        "file_key", F.lit("SHA256").alias("algorithm"), F.sha2(F.col("size").cast("string"), 256).alias("hash"))
    sha1 = t.files.filter("catalog_status = 'Verified'").select(
        "file_key", F.lit("SHA1").alias("algorithm"), F.sha1("path").alias("hash"))
    return sha256.unionByName(sha1)


_INVENTORY_SQL = """SELECT coalesce(s.system_name, '') AS system, coalesce(g.title, '') AS game_title, f.file_name, f.path,
    f.location AS source_folder, f.format_name AS format, f.size, f.modified, f.region, f.language, f.revision,
    f.version, f.status, f.catalog_status, f.catalog_source, f.catalog_name, f.is_preferred, f.is_manual,
    f.is_excluded, 0 AS preference_score, f.quick_hash,
    (SELECT max(hash) FROM hashes h WHERE h.file_key = f.file_key AND algorithm = 'SHA256') AS sha256,
    (SELECT max(hash) FROM hashes h WHERE h.file_key = f.file_key AND algorithm = 'SHA1') AS sha1
    FROM files f LEFT JOIN games g ON g.game_key = f.game_key LEFT JOIN systems s ON s.system_key = g.system_key"""


def _inventory(t: Tables):
    files = t.files.withColumn("preference_score", F.lit(0))
    return views.inventory_rows(files, t.games, t.systems, stored_hashes(t))


@query("J14_inventory_rows", with_ctes("files games systems", _INVENTORY_SQL, {"hashes": _HASHES_SQL}))
def j14(t: Tables):
    return _inventory(t)


@query("J16_game_details", with_ctes("files games systems formats", """SELECT g.game_key, g.system_key, g.title, g.is_wanted,
    s.system_name, s.manufacturer, f.file_key, f.file_name, f.path, f.size, f.status, f.catalog_status,
    f.format_name, m.format_type, m.priority FROM games g JOIN systems s ON s.system_key = g.system_key
    LEFT JOIN files f ON f.game_key = g.game_key LEFT JOIN (SELECT system_key, extension, min(format_type) AS format_type,
        min(priority) AS priority FROM formats GROUP BY ALL) m ON m.system_key = g.system_key AND m.extension = f.extension
        AND f.format_name = 'Image'"""))
def j16(t: Tables):
    # The files call every format "Image", so the platform formats of a system and extension go by that name.
    formats = t.formats.groupBy("system_key", "extension").agg(F.min("format_type").alias("format_type"), F.min("priority").alias("priority"))
    rows = views.details_of(t.games, t.files, t.systems, formats.withColumn("format_name", F.lit("Image")))
    return rows.select("game_key", "system_key", "title", "is_wanted", "system_name", "manufacturer", "file_key", "file_name",
                       "path", "size", "status", "catalog_status", "format_name", "format_type", "priority")


@query("J17_purge_orphan_games", with_ctes("games files", """SELECT g.game_key, g.title FROM games g
    WHERE EXISTS (SELECT 1 FROM files f WHERE f.game_key = g.game_key AND f.location <> '/shelf3')"""))
def j17(t: Tables):
    return reconcile.purge_orphan_games(t.games, t.files.filter("location <> '/shelf3'")).select("game_key", "title")


_DUPLICATES_SQL = """SELECT h.hash AS sha256, s.system_name AS system, g.title AS game_title, f.file_name, f.path, f.size
    FROM files f JOIN hashes h ON h.file_key = f.file_key AND h.algorithm = 'SHA256'
    JOIN games g ON g.game_key = f.game_key JOIN systems s ON s.system_key = g.system_key
    WHERE f.status = 'Duplicate'"""


def _duplicate_report(t: Tables):
    return duplicates.duplicate_report(t.files, t.games, stored_hashes(t), t.systems)


@query("J15_duplicate_report", with_ctes("files games systems", _DUPLICATES_SQL, {"hashes": _HASHES_SQL}))
def j15(t: Tables):
    return _duplicate_report(t)


# --- written reports and exports ----------------------------------------------

@query("S9_write_inventory_csv", with_ctes("files games systems", """SELECT system AS "System", game_title AS "Game Title",
    file_name AS "File Name", path AS "Full Path", source_folder AS "Source Folder", format AS "Format",
    CAST(size AS STRING) AS "Size Bytes", strftime(modified, '%Y-%m-%dT%H:%M:%S') || '.0000000Z' AS "Modified UTC",
    nullif(region, '') AS "Region", CAST(NULL AS STRING) AS "Language", nullif(revision, '') AS "Revision",
    version AS "Version", status AS "Status", catalog_status AS "Catalog Status", catalog_source AS "Catalog Source",
    catalog_name AS "Catalog Name", CASE WHEN is_preferred THEN 'True' ELSE 'False' END AS "Preferred",
    CASE WHEN is_manual THEN 'True' ELSE 'False' END AS "Manual Preference",
    CASE WHEN is_excluded THEN 'True' ELSE 'False' END AS "Excluded",
    CAST(preference_score AS STRING) AS "Preference Score", quick_hash AS "Quick Hash", sha256 AS "SHA-256",
    sha1 AS "SHA-1" FROM inventory""", {"hashes": _HASHES_SQL, "inventory": _INVENTORY_SQL}))
def s9(t: Tables):
    path = scratch_path(t.spark, "inventory-csv")
    sinks.write_inventory_csv(_inventory(t), path, "gzip")
    return sinks.read_report_csv(t.spark, path)


@query("S10_write_duplicate_csv", with_ctes("files games systems", """SELECT sha256 AS "SHA-256", system AS "System",
    game_title AS "Game Title", file_name AS "File Name", path AS "Full Path", CAST(size AS STRING) AS "Size Bytes"
    FROM report""", {"hashes": _HASHES_SQL, "report": _DUPLICATES_SQL}))
def s10(t: Tables):
    path = scratch_path(t.spark, "duplicate-csv")
    sinks.write_duplicate_csv(_duplicate_report(t), path, "gzip")
    return sinks.read_report_csv(t.spark, path)


_EXPORT_SQL = """SELECT s.system_name, f.path, f.file_name, f.is_directory, f.size FROM files f
    JOIN games g ON g.game_key = f.game_key JOIN systems s ON s.system_key = g.system_key
    WHERE f.is_preferred AND f.status <> 'Missing'"""


@query("F14_preferred_export_files", with_ctes("files games systems", _EXPORT_SQL + " AND g.is_wanted"))
def f14(t: Tables):
    return views.preferred_export_files(t.files, t.games, t.systems, only_wanted=True)


def _destination(t: Tables):
    """What an earlier export left behind: the large files, some since changed."""
    earlier = views.preferred_export_files(t.files, t.games, t.systems)
    target = F.concat_ws("/", F.regexp_replace("system_name", "/", "_"), "file_name")
    return earlier.filter("size > 3000000").select(
        target.alias("target"), F.when(F.col("size") > 6000000, F.col("size") + 1).otherwise(F.col("size")).alias("size"))


@query("S11_export_manifest", with_ctes("files games systems", """
    SELECT e.system_name, e.path, e.target, e.is_directory, e.size,
      CASE WHEN (SELECT max(CASE WHEN d.size > 6000000 THEN d.size + 1 ELSE d.size END) FROM named d
                 WHERE d.target = e.target AND d.size > 3000000) = e.size THEN 'skip' ELSE 'copy' END AS action,
      count(*) OVER (PARTITION BY upper(e.target)) > 1 AS collides FROM named e""",
    {"exports": _EXPORT_SQL,
     "named": "SELECT *, replace(system_name, '/', '_') || '/' || file_name AS target FROM exports"}))
def s11(t: Tables):
    return sinks.export_manifest(views.preferred_export_files(t.files, t.games, t.systems), _destination(t))


@query("C18_artwork_key", with_ctes("files games", r"""SELECT f.file_key, regexp_replace(
    CASE WHEN trim(coalesce(f.catalog_name, '')) <> '' THEN f.catalog_name
         WHEN trim(coalesce(f.region, '')) = '' THEN g.title
         ELSE g.title || ' (' || trim(string_split(f.region, ',')[1]) || ')' END,
    '[&*/:`<>?\\|"]', '_', 'g') AS artwork FROM files f JOIN games g ON g.game_key = f.game_key"""))
def c18(t: Tables):
    rows = t.files.select("file_key", "game_key", "catalog_name", "region").join(
        t.games.select("game_key", "title"), "game_key")
    return rows.select("file_key", artwork_key(F.col("catalog_name"), F.col("title"), F.col("region")).alias("artwork"))


@query("U7_set_wanted", with_ctes("files games", """SELECT game_key, is_wanted OR game_key IN (
    SELECT game_key FROM files WHERE status = 'Duplicate') AS is_wanted FROM games"""))
def u7(t: Tables):
    keys = t.files.filter("status = 'Duplicate'").select("game_key")
    return preference.set_wanted(t.games, keys, True).select("game_key", "is_wanted")
