"""Catalog verification over documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.model import builtin_catalog_sources, catalog_sources
from shelfmark.operators import verification
from shelfmark.sources.listing import read_archive_members
from shelfmark.workload.base import Tables, _values, query, with_ctes
from shelfmark.workload.naming import CRC_SQL
from shelfmark.workload.scanning import zipped_documents

# English documents get a 16-byte header before a body of whole 8 KiB banks, German ones a
# 512-byte header before whole KiB; French ones stay plain; Spanish ones have no catalog.
_SYSTEM = "CASE lang WHEN 'en' THEN 'NES' WHEN 'de' THEN 'SNES' WHEN 'fr' THEN 'GBA' ELSE 'MAME' END"
_EXTENSION = "CASE lang WHEN 'en' THEN '.nes' WHEN 'de' THEN '.sfc' WHEN 'fr' THEN '.gba' ELSE '.chd' END"
_HEADER = "CASE lang WHEN 'en' THEN 16 WHEN 'de' THEN 512 ELSE 0 END"
_BANK = "CASE lang WHEN 'en' THEN 8192 WHEN 'de' THEN 1024 ELSE 1 END"


def _body(length: str) -> str:
    return f"text || repeat(' ', CAST(({_BANK} - {length} % {_BANK}) % {_BANK} AS INT))"


# The catalog lists the labelled documents: good ones by SHA-1, others by CRC-32 only. Toxic
# ones carry a wrong size; French ones listed by SHA-1 carry none.
_CATALOG_SIZE = "CASE WHEN toxic = 1 THEN size + 1 WHEN system_key = 'GBA' AND quality = 1 THEN 0 ELSE size END"

_CTES = {
    "bodies": f"""SELECT doc_id, CAST(doc_id AS STRING) AS file_key, {_SYSTEM} AS system_key, {_EXTENSION} AS extension,
        repeat('H', {_HEADER}) AS header, {_body("strlen(text)")} AS body FROM documents""",
    "hashed": f"""SELECT doc_id, file_key, system_key, extension, strlen(header || body_text) AS size,
        CASE WHEN strlen(header) > 0 THEN strlen(body_text) END AS payload_size, upper(sha1(header || body_text)) AS sha1,
        CASE WHEN strlen(header) > 0 THEN upper(sha1(body_text)) END AS payload_sha1, raw_crc AS crc32,
        CASE WHEN strlen(header) > 0 THEN body_crc END AS payload_crc32
        FROM (SELECT *, {CRC_SQL} AS raw_crc FROM (SELECT *, encode(header || body_text) AS body FROM (
          SELECT * EXCLUDE (body), body AS body_text, {CRC_SQL.replace("(body)", "(encode(body))")} AS body_crc FROM bodies) a) b) c""",
    "entries": f"""SELECT position, system_key, name, {_CATALOG_SIZE} AS size, CASE WHEN quality = 0 THEN crc END AS crc32,
        CASE WHEN quality = 1 THEN sha END AS sha1 FROM (SELECT l.doc_id AS position, h.system_key,
          'Doc ' || CAST(l.doc_id AS STRING) AS name, l.quality, l.toxic, coalesce(h.payload_size, h.size) AS size,
          coalesce(h.payload_sha1, h.sha1) AS sha, coalesce(h.payload_crc32, h.crc32) AS crc
          FROM labels l JOIN hashed h ON h.doc_id = l.doc_id WHERE h.system_key <> 'MAME') a""",
    "by_sha": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_key, sha1 ORDER BY position) AS n FROM entries WHERE sha1 IS NOT NULL) a WHERE n = 1",
    "by_crc": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_key, size, crc32 ORDER BY position) AS n FROM entries WHERE sha1 IS NULL AND crc32 IS NOT NULL) a WHERE n = 1",
    "matched": """SELECT h.*, coalesce(a.name, b.name, c.name, d.name) AS catalog_name,
        CASE WHEN a.name IS NOT NULL THEN 1 WHEN b.name IS NOT NULL THEN 2 WHEN c.name IS NOT NULL THEN 3
             WHEN d.name IS NOT NULL THEN 4 END AS match_rank FROM hashed h
        LEFT JOIN by_sha a ON a.system_key = h.system_key AND a.sha1 = h.sha1 AND (a.size = 0 OR a.size = h.size)
        LEFT JOIN by_crc b ON b.system_key = h.system_key AND b.size = h.size AND b.crc32 = h.crc32
        LEFT JOIN by_sha c ON c.system_key = h.system_key AND c.sha1 = h.payload_sha1 AND (c.size = 0 OR c.size = h.payload_size)
        LEFT JOIN by_crc d ON d.system_key = h.system_key AND d.size = h.payload_size AND d.crc32 = h.payload_crc32""",
}


def contents(t: Tables):
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("file_key"), F.expr(_SYSTEM).alias("system_key"),
        F.expr(_EXTENSION).alias("extension"),
        F.encode(F.expr(f"repeat('H', {_HEADER}) || {_body('octet_length(text)')}"), "UTF-8").alias("content"))
    return rows


def hashed(t: Tables):
    return verification.content_hashes(contents(t))


def catalog(t: Tables):
    labels = t.labels.select(F.col("doc_id").alias("position"), F.col("doc_id").cast("string").alias("file_key"),
                             "quality", "toxic")
    rows = hashed(t).filter("system_key <> 'MAME'").join(labels, "file_key")
    size = F.coalesce("payload_size", "size")
    rows = rows.select("position", "system_key", F.concat(F.lit("Doc "), "file_key").alias("name"), size.alias("size"),
                       F.when(F.col("quality") == 0, F.coalesce("payload_crc32", "crc32")).alias("crc32"),
                       F.when(F.col("quality") == 1, F.coalesce("payload_sha1", "sha1")).alias("sha1"), "toxic", "quality")
    return rows.select("position", "system_key", "name", F.expr(_CATALOG_SIZE).alias("size"), "crc32", "sha1",
                       F.col("name").alias("rom_name"), F.lit("catalog").alias("source_file"))


@query("A10_catalog_index", with_ctes("", """SELECT system_key, name, size FROM by_sha UNION ALL
    SELECT system_key, name, size FROM by_crc""", _CTES))
def a10(t: Tables):
    return verification.catalog_index(catalog(t)).select(
        "system_key", F.col("entry_name").alias("name"), F.col("entry_size").alias("size"))


def _matches(t: Tables, rank: int):
    found = verification.match_catalog(hashed(t), verification.catalog_index(catalog(t)))
    return found.filter(F.col("match_rank") == rank).select("file_key", "catalog_name", "stored_sha1", "stored_crc32")


def _match_sql(rank: int, sha1: str, crc: str) -> str:
    return with_ctes("", f"""SELECT file_key, catalog_name, {sha1} AS stored_sha1, {crc} AS stored_crc32 FROM matched
        WHERE match_rank = {rank}""", _CTES)


@query("J9_match_catalog_sha1", _match_sql(1, "sha1", "crc32"))
def j9(t: Tables):
    return _matches(t, 1)


@query("J10_match_catalog_crc", _match_sql(2, "sha1", "crc32"))
def j10(t: Tables):
    return _matches(t, 2)


@query("J11_match_headerless", with_ctes("", """SELECT file_key, catalog_name, match_rank,
    CASE WHEN match_rank < 3 THEN sha1 ELSE coalesce(payload_sha1, sha1) END AS stored_sha1,
    CASE WHEN match_rank < 3 THEN crc32 ELSE coalesce(payload_crc32, crc32) END AS stored_crc32 FROM matched""", _CTES))
def j11(t: Tables):
    return verification.match_catalog(hashed(t), verification.catalog_index(catalog(t))).select(
        "file_key", "catalog_name", "match_rank", "stored_sha1", "stored_crc32")


# Zipped documents: each archive holds its source name and its text; the catalog lists both kinds.
_ZIP_CTES = {
    "zip_entries": """SELECT 'Source ' || source AS name, upper(sha1(source)) AS sha1, source AS position
        FROM (SELECT DISTINCT source FROM documents WHERE lang = 'fr' AND source < 'src15') a
        UNION ALL SELECT 'Text ' || min(CAST(d.doc_id AS STRING)), upper(sha1(d.text)), min('x' || CAST(d.doc_id AS STRING))
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.text""",
    "zip_members": """SELECT CAST(doc_id AS STRING) || '.zip' AS file_key, 0 AS position, upper(sha1(source)) AS sha1 FROM documents
        UNION ALL SELECT CAST(doc_id AS STRING) || '.zip', 1, upper(sha1(text)) FROM documents""",
}


def _zip_catalog(t: Tables):
    sources = (t.documents.filter("lang = 'fr' and source < 'src15'").select("source").distinct()
               .select(F.concat(F.lit("Source "), "source").alias("name"), F.upper(F.sha1("source")).alias("sha1")))
    labelled = t.documents.join(t.labels.select("doc_id"), "doc_id")
    texts = (labelled.groupBy(F.upper(F.sha1("text")).alias("sha1"))
             .agg(F.concat(F.lit("Text "), F.min(F.col("doc_id").cast("string"))).alias("name")))
    return sources.unionByName(texts.select("name", "sha1")).select(
        F.lit("NES").alias("system_key"), "name", F.col("name").alias("rom_name"), F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("string").alias("crc32"), "sha1", F.lit("zips").alias("source_file"), F.col("name").alias("position"))


@query("J12_match_archive_members", with_ctes("", """SELECT file_key, name AS catalog_name, sha1 AS stored_sha1 FROM (
    SELECT m.file_key, e.name, m.sha1, row_number() OVER (PARTITION BY m.file_key ORDER BY m.position) AS n
    FROM zip_members m JOIN zip_entries e ON e.sha1 = m.sha1) a WHERE n = 1""", _ZIP_CTES))
def j12(t: Tables):
    archives = zipped_documents(t).select(F.col("path").alias("file_key"), F.lit("NES").alias("system_key"), "content")
    members = verification.content_hashes(read_archive_members(archives))
    found = verification.match_archive_members(members, verification.catalog_index(_zip_catalog(t)))
    return found.select("file_key", "catalog_name", "stored_sha1")


# Whole verification: one source of documents stands for folder packages; one catalogued system has no rows.
_SOURCES_SQL = _values([(row[0], row[3]) for row in catalog_sources()], "system_key, catalog_source")
_VERIFY_CTES = {**_CTES, "sources": _SOURCES_SQL, "verified": """SELECT m.file_key, m.system_key,
    CASE WHEN d.source = 'src3' OR s.catalog_source IS NULL THEN 'Unsupported' WHEN d.source = 'src5' THEN 'Error'
         WHEN m.catalog_name IS NOT NULL THEN 'Verified' ELSE 'NoMatch' END AS catalog_status,
    CASE WHEN d.source = 'src3' THEN 'Folder-based install' WHEN s.catalog_source IS NULL THEN 'No catalog mapping'
         ELSE s.catalog_source END AS catalog_source, m.catalog_name,
    CASE WHEN match_rank < 3 THEN sha1 ELSE coalesce(payload_sha1, sha1) END AS stored_sha1,
    CASE WHEN match_rank < 3 THEN crc32 ELSE coalesce(payload_crc32, crc32) END AS stored_crc32
    FROM matched m JOIN documents d ON d.doc_id = m.doc_id LEFT JOIN sources s ON s.system_key = m.system_key""",
    "updates": """SELECT file_key, system_key, catalog_status, catalog_source,
    CASE WHEN catalog_status IN ('Verified', 'NoMatch') THEN catalog_name END AS catalog_name,
    CASE WHEN catalog_status IN ('Verified', 'NoMatch') THEN stored_sha1 END AS sha1,
    CASE WHEN catalog_status IN ('Verified', 'NoMatch') THEN stored_crc32 END AS crc32 FROM verified"""}


def updates(t: Tables):
    files = t.documents.select(F.col("doc_id").cast("string").alias("file_key"), F.expr(_SYSTEM).alias("system_key"),
                               (F.col("source") == "src3").alias("is_directory"), F.expr(_EXTENSION).alias("extension"),
                               "source")
    failures = files.filter("source = 'src5'").select("file_key")
    return verification.verify_catalog(files, hashed(t), catalog(t), builtin_catalog_sources(t.spark), failures=failures)


@query("U6_verify_catalog", with_ctes("", "SELECT * FROM updates", _VERIFY_CTES))
def u6(t: Tables):
    return updates(t)


@query("A9_verification_outcomes", with_ctes("", """SELECT system_key, count(*) AS files,
    count(*) FILTER (WHERE catalog_status = 'Verified') AS verified, count(*) FILTER (WHERE catalog_status = 'NoMatch') AS no_match,
    count(*) FILTER (WHERE catalog_status = 'Unsupported') AS unsupported, count(*) FILTER (WHERE catalog_status = 'Error') AS errors
    FROM updates GROUP BY ROLLUP (system_key)""", _VERIFY_CTES))
def a9(t: Tables):
    return verification.verification_outcomes(updates(t))


_AT = "2004-01-01 00:00:00"


@query("U5_apply_verification", with_ctes("", f"""SELECT CAST(d.doc_id AS STRING) AS file_key,
    coalesce(u.catalog_status, 'Unknown') AS catalog_status, coalesce(u.catalog_source, 'before') AS catalog_source,
    u.catalog_name, CASE WHEN u.file_key IS NOT NULL THEN TIMESTAMP '{_AT}' END AS catalog_verified_at
    FROM documents d LEFT JOIN updates u ON u.file_key = CAST(d.doc_id AS STRING) AND u.system_key <> 'GBA'""", _VERIFY_CTES))
def u5(t: Tables):
    files = t.documents.select(F.col("doc_id").cast("string").alias("file_key"), F.lit("Unknown").alias("catalog_status"),
                               F.lit("before").alias("catalog_source"), F.lit(None).cast("string").alias("catalog_name"),
                               F.lit(None).cast("timestamp_ntz").alias("catalog_verified_at"))
    return verification.apply_verification(files, updates(t).filter("system_key <> 'GBA'"),
                                           F.lit(_AT).cast("timestamp_ntz"))


@query("U5_upsert_hashes", with_ctes("", """SELECT file_key, 'SHA1' AS algorithm, sha1 AS hash FROM updates WHERE sha1 IS NOT NULL
    UNION ALL SELECT file_key, 'CRC32', crc32 FROM updates WHERE crc32 IS NOT NULL
    UNION ALL SELECT file_key, 'SHA1', 'old' FROM updates WHERE sha1 IS NULL
    UNION ALL SELECT file_key, 'SHA256', 'kept' FROM updates""", _VERIFY_CTES))
def u5_hashes(t: Tables):
    files = t.documents.select(F.col("doc_id").cast("string").alias("file_key"))
    stored = files.select("file_key", F.lit("SHA1").alias("algorithm"), F.lit("old").alias("hash")).unionByName(
        files.select("file_key", F.lit("SHA256").alias("algorithm"), F.lit("kept").alias("hash")))
    return verification.upsert_hashes(stored, updates(t), files)


@query("F13_verification_candidates", with_ctes("files games", """SELECT f.file_key, g.system_key FROM files f
    JOIN games g ON g.game_key = f.game_key WHERE f.status <> 'Missing' AND f.catalog_status IN ('Unknown', 'Error')"""))
def f13(t: Tables):
    return verification.verification_candidates(t.files, t.games).select("file_key", "system_key")
