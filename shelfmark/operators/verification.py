"""Content hashes against published checksum catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.hashing import crc32_hex, header_skip, payload, sha1_hex


def verification_candidates(files: DataFrame, games: DataFrame, system_key: str | None = None,
                            include_checked: bool = False) -> DataFrame:
    """Present files of known games; by default only those never checked or failed."""
    rows = files.filter((F.col("status") != "Missing") & F.col("game_key").isNotNull())
    if not include_checked:
        rows = rows.filter(F.col("catalog_status").isin("Unknown", "Error"))
    owners = games.select("game_key", "system_key")
    if system_key is not None and system_key.strip():
        owners = owners.filter(F.col("system_key") == system_key)
    return rows.drop("system_key").join(owners, "game_key")


def content_hashes(contents: DataFrame) -> DataFrame:
    """SHA-1, CRC-32 and the same of the payload behind a copier header.

    ``contents``: file_key, system_key, extension, content. The bytes are hashed
    in the scan stage and dropped; no shuffle ever carries them.
    """
    size = F.length("content").cast("long")
    skip = header_skip(F.col("system_key"), F.col("extension"), size)
    body = F.when(skip > 0, payload(F.col("content"), skip))
    return contents.select(
        *[name for name in contents.columns if name not in ("content", "size")],
        size.alias("size"), sha1_hex(F.col("content")).alias("sha1"), crc32_hex(F.col("content")).alias("crc32"),
        skip.alias("header_skip"), F.when(skip > 0, size - skip).alias("payload_size"),
        sha1_hex(body).alias("payload_sha1"), F.when(skip > 0, crc32_hex(body)).alias("payload_crc32"))


def catalog_index(entries: DataFrame) -> DataFrame:
    """First catalog row per (system, SHA-1), and per (system, size, CRC) without SHA-1.

    One table keyed by (system_key, probe), so a file needs one join for all
    of its hashes.
    """
    by_sha1 = F.when(F.col("sha1").isNotNull(), F.concat(F.lit("sha1:"), F.upper("sha1")))
    by_crc = F.when(F.col("crc32").isNotNull(), F.concat_ws(":", F.lit("crc"), F.col("size").cast("string"), "crc32"))
    keyed = entries.withColumn("probe", F.coalesce(by_sha1, by_crc)).filter(F.col("probe").isNotNull())
    order = F.struct("source_file", "position")
    return (keyed.groupBy("system_key", "probe")
            .agg(F.min_by(F.struct("name", "rom_name", "size"), order).alias("entry"))
            .select("system_key", "probe", F.col("entry.name").alias("entry_name"),
                    F.col("entry.rom_name").alias("entry_rom_name"), F.col("entry.size").alias("entry_size")))


def _probes(hashed: DataFrame, keys: list[str]) -> DataFrame:
    def probe(rank: int, kind: str, sha1: str, crc: str, size: str):
        text = (F.concat(F.lit("sha1:"), F.col(sha1)) if kind == "sha1"
                else F.concat_ws(":", F.lit("crc"), F.col(size).cast("string"), crc))
        return F.when(F.col(sha1).isNotNull(), F.struct(
            F.lit(rank).alias("rank"), text.alias("probe"), F.col(size).alias("probe_size"),
            F.col(sha1).alias("matched_sha1"), F.col(crc).alias("matched_crc32")))

    options = F.array(probe(1, "sha1", "sha1", "crc32", "size"),
                      probe(2, "crc", "sha1", "crc32", "size"),
                      probe(3, "sha1", "payload_sha1", "payload_crc32", "payload_size"),
                      probe(4, "crc", "payload_sha1", "payload_crc32", "payload_size"))
    return hashed.select(*keys, "system_key",
                         F.inline(F.filter(options, lambda option: option.isNotNull())))


def _hits(hashed: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    joined = _probes(hashed, keys).join(index, ["system_key", "probe"])
    return joined.filter(~F.col("probe").startswith("sha1:") | (F.col("entry_size") == 0)
                         | (F.col("entry_size") == F.col("probe_size")))


_HIT = ["rank", "entry_name", "matched_sha1", "matched_crc32"]


def match_catalog(hashed: DataFrame, index: DataFrame) -> DataFrame:
    """Files with their catalog match: SHA-1 first, then CRC, raw before payload.

    Without a match the hashes kept are those of the last attempt.
    """
    best = (_hits(hashed, index, ["file_key"]).groupBy("file_key")
            .agg(F.min(F.struct(*_HIT)).alias("hit")))
    joined = hashed.join(best, "file_key", "left")
    return (joined.withColumn("catalog_name", F.col("hit.entry_name"))
            .withColumn("match_rank", F.col("hit.rank"))
            .withColumn("stored_sha1", F.coalesce("hit.matched_sha1", "payload_sha1", "sha1"))
            .withColumn("stored_crc32", F.coalesce("hit.matched_crc32", "payload_crc32", "crc32"))
            .drop("hit"))


def match_archive_members(members: DataFrame, index: DataFrame) -> DataFrame:
    """Per archive, the first member that matches; archives without one yield no row.

    ``members``: file_key of the archive, position, and the columns of
    ``content_hashes`` for the member.
    """
    best = (_hits(members, index, ["file_key", "position"]).groupBy("file_key")
            .agg(F.min(F.struct("position", *_HIT)).alias("hit")))
    return best.select("file_key", F.col("hit.entry_name").alias("catalog_name"),
                       F.col("hit.rank").alias("match_rank"),
                       F.col("hit.matched_sha1").alias("stored_sha1"),
                       F.col("hit.matched_crc32").alias("stored_crc32"))


def verify_catalog(candidates: DataFrame, hashed: DataFrame, entries: DataFrame, sources: DataFrame,
                   members: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """Verification updates for all systems in one plan.

    ``candidates``: file_key, system_key, is_directory, extension.
    ``hashed``: output of ``content_hashes``; ``entries``: catalog rows with
    system_key; ``sources``: system_key, catalog_source; ``members``: hashed
    archive members; ``failures``: file_key of files that could not be read.
    """
    index = catalog_index(entries)
    loaded = entries.select("system_key").distinct().withColumn("has_entries", F.lit(True))
    is_archive = F.lower("extension").isin(".zip", ".7z", ".rar")
    matched = match_catalog(hashed, index).select("file_key", "catalog_name", "stored_sha1", "stored_crc32")
    rows = (candidates.select("file_key", "system_key", "is_directory", "extension")
            .join(sources.select("system_key", "catalog_source"), "system_key", "left")
            .join(loaded, "system_key", "left")
            .join(matched, "file_key", "left"))
    if members is not None:
        inside = match_archive_members(members, index).select(
            "file_key", F.struct("catalog_name", "stored_sha1", "stored_crc32").alias("inside"))
        rows = rows.join(inside, "file_key", "left")
    else:
        rows = rows.withColumn("inside", F.lit(None).cast(
            "struct<catalog_name:string,stored_sha1:string,stored_crc32:string>"))
    if failures is not None:
        rows = rows.join(failures.select("file_key").distinct().withColumn("failed", F.lit(True)), "file_key", "left")
    else:
        rows = rows.withColumn("failed", F.lit(False))
    def found(name: str):
        return F.when(is_archive, F.col(f"inside.{name}")).otherwise(F.col(name))
    # No reader for these kinds is at hand: their content is unknown, so nothing is settled.
    unread = F.lower("extension").isin(".7z", ".rar")
    status = (F.when(F.col("is_directory"), "Unsupported")
              .when(F.col("catalog_source").isNull(), "Unsupported")
              .when(unread, "Unsupported")
              .when(F.col("has_entries").isNull(), "Error")
              .when(F.coalesce("failed", F.lit(False)), "Error")
              .when(found("catalog_name").isNotNull(), "Verified").otherwise("NoMatch"))
    settled = F.col("catalog_status").isin("Verified", "NoMatch")
    source = (F.when(F.col("is_directory"), "Folder-based install")
              .when(F.col("catalog_source").isNull(), "No catalog mapping")
              .when(unread, "No reader for this archive type").otherwise(F.col("catalog_source")))
    return (rows.withColumn("catalog_status", status)
            .select("file_key", "system_key", "catalog_status", source.alias("catalog_source"),
                    F.when(settled, found("catalog_name")).alias("catalog_name"),
                    F.when(settled, found("stored_sha1")).alias("sha1"),
                    F.when(settled, found("stored_crc32")).alias("crc32")))


def verification_outcomes(updates: DataFrame) -> DataFrame:
    """Files per system and outcome, with a grand total row (system null)."""
    def hits(name: str):
        return F.count_if(F.col("catalog_status") == name)
    return updates.rollup("system_key").agg(
        F.count("*").alias("files"), hits("Verified").alias("verified"), hits("NoMatch").alias("no_match"),
        hits("Unsupported").alias("unsupported"), hits("Error").alias("errors"))


def apply_verification(files: DataFrame, updates: DataFrame, verified_at) -> DataFrame:
    """Files with the latest update applied; updates to unknown files are ignored.

    ``updates`` may carry ``position``; the highest one per file wins.
    """
    fields = F.struct("catalog_status", "catalog_source", "catalog_name")
    order = F.col("position") if "position" in updates.columns else F.lit(0)
    last = updates.groupBy("file_key").agg(F.max_by(fields, order).alias("__update"))
    hit = F.col("__update").isNotNull()
    joined = files.join(last, "file_key", "left")
    for name in ("catalog_status", "catalog_source", "catalog_name"):
        joined = joined.withColumn(name, F.when(hit, F.col(f"__update.{name}")).otherwise(F.col(name)))
    return joined.withColumn("catalog_verified_at", F.when(hit, verified_at).otherwise(
        F.col("catalog_verified_at"))).drop("__update")


def upsert_hashes(hashes: DataFrame, updates: DataFrame, files: DataFrame) -> DataFrame:
    """Hash table with the SHA-1 and CRC-32 of the updates; blank ones change nothing."""
    known = updates.join(files.select("file_key"), "file_key", "left_semi")
    order = F.col("position") if "position" in updates.columns else F.lit(0)
    def last(column: str, algorithm: str) -> DataFrame:
        present = known.filter(F.col(column).isNotNull() & (F.trim(column) != ""))
        return (present.groupBy("file_key").agg(F.max_by(column, order).alias("hash"))
                .select("file_key", F.lit(algorithm).alias("algorithm"), "hash"))
    fresh = last("sha1", "SHA1").unionByName(last("crc32", "CRC32"))
    kept = hashes.select("file_key", "algorithm", "hash").join(fresh, ["file_key", "algorithm"], "left_anti")
    return kept.unionByName(fresh)
