"""A whole verification: candidates, content hashes, catalog match, new file table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import preference, verification
from shelfmark.plans.scan_job import Library
from shelfmark.session import shared_folder
from shelfmark.sources.listing import hash_archive_members, hash_files, spread_by_bytes


def verify(library: Library, entries: DataFrame, sources: DataFrame, verified_at,
           system_key: str | None = None, include_checked: bool = False) -> tuple[Library, DataFrame]:
    """The library after verification, and the updates themselves.

    Only candidates are read. Their bytes are hashed in the task that reads
    them, so nothing but hashes is ever shuffled.
    """
    shared_folder(library.files.sparkSession)
    candidates = verification.verification_candidates(
        library.files, library.games, system_key, include_checked)
    wanted = candidates.filter(~F.col("is_directory")).select("file_key", "path", "size", "system_key", "extension").checkpoint()
    archive = F.lower("extension").isin(".zip", ".7z", ".rar")
    hashed = hash_files(spread_by_bytes(wanted.filter(~archive))).checkpoint()
    members = hash_archive_members(spread_by_bytes(wanted.filter(F.lower("extension") == ".zip"))).checkpoint()
    updates = verification.verify_catalog(
        candidates, hashed.filter(~F.col("failed")), entries, sources, members.filter(~F.col("failed")),
        failures=hashed.filter("failed").select("file_key").unionByName(members.filter("failed").select("file_key"))).checkpoint()
    files = verification.apply_verification(library.files, updates, verified_at)
    hashes = verification.upsert_hashes(library.hashes, updates, library.files)
    return Library(preference.elect_preferred(files), library.games, hashes), updates
