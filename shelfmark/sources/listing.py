"""File listings, file contents and archive members as DataFrames."""

from __future__ import annotations

import hashlib
import io
import math
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions.hashing import header_skip, quick_hash
from shelfmark.functions.text import base_name, extension_of
from shelfmark.sources.paths import is_remote, local_path
from shelfmark.sources.tree import list_trees

#: What a reader hands over at a time, so that member contents never pile up in a task.
ROWS_PER_BATCH = 10_000
#: Bytes of content that one task reads and hashes.
BYTES_PER_TASK = 1 << 30
BYTES_PER_BATCH = 64 << 20


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """One row per file below ``root``. Only metadata is read, never content.

    ``created`` is null, as neither Spark nor Python reports it everywhere. Files that vanish while listing are
    skipped; ``tree.list_trees`` also names what could not be read. A store that is not mounted
    is listed by Spark's reader, which keeps the list on the driver and leaves out hidden files.
    """
    if not is_remote(root):
        locations = spark.createDataFrame([(root, recursive)], "location string, recursive boolean")
        return list_trees(locations).files
    rows = (spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower())
            .option("ignoreMissingFiles", "true").load(root))
    return listing_rows(rows, root)


def listing_rows(binary_rows: DataFrame, location: str) -> DataFrame:
    """Binary-file rows (path, modificationTime, length) → listing rows."""
    path = F.regexp_replace("path", r"^file:/+", "/")
    return binary_rows.select(
        path.alias("path"), base_name(path).alias("file_name"), extension_of(base_name(path)).alias("extension"),
        F.col("length").alias("size"), F.lit(None).cast("timestamp").alias("created"),
        F.col("modificationTime").alias("modified"), F.lit(location).alias("location"))


def read_contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size, content for files of moderate size (below Spark's 2 GB row limit)."""
    rows = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root))
    return rows.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"),
                       F.col("length").alias("size"), "content")


def quick_hash_files(paths: DataFrame, sample: int = V.QUICK_HASH_SAMPLE) -> DataFrame:
    """Quick hash of files too large to read whole: two seeks per file, null if unreadable.

    ``paths``: path, size. The head and tail are read inside the tasks through a
    mounted file system; the hash itself stays a column expression.
    """
    def read_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [_ends(path, size, sample) for path, size in zip(batch["path"], batch["size"])]
            heads, tails = [head for head, _ in ends], [tail for _, tail in ends]
            yield pd.DataFrame({"path": batch["path"], "size": batch["size"], "head": heads, "tail": tails})

    ends = paths.select("path", "size").mapInPandas(read_ends, "path string, size long, head binary, tail binary")
    return ends.select("path", "size", F.upper(F.sha2(F.concat(
        F.encode(F.col("size").cast("string"), "UTF-8"), "head", "tail"), 256)).alias("quick_hash"))


def spread_by_bytes(files: DataFrame, size="size", each: int = BYTES_PER_TASK) -> DataFrame:
    """``files`` over as many tasks as their content needs; call it on stored rows, of which it takes one sum.

    The rows that name files are few bytes each, so nothing else would give more than a handful of tasks.
    """
    total = files.agg(F.sum(size).cast("long")).first()[0] or 0
    return files.repartition(max(1, math.ceil(total / each)), "path")


def _ends(path: str, size: int, sample: int) -> tuple[bytes | None, bytes | None]:
    path = local_path(path)
    try:
        with open(path, "rb") as stream:
            head = stream.read(sample)
            stream.seek(max(0, size - sample))
            return head, stream.read(sample) if size > sample else b""
    except OSError:
        return None, None


def _file_sha256(path: str) -> str | None:
    path = local_path(path)
    try:
        with open(path, "rb") as stream:
            return hashlib.file_digest(stream, "sha256").hexdigest().upper()
    except OSError:
        return None


def sha256_files(paths: DataFrame) -> DataFrame:
    """SHA-256 of whole files, streamed in blocks inside the tasks; null if unreadable.

    ``paths``: path and any key columns. Meant for the few files whose quick
    hashes collide.
    """
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [_file_sha256(path) for path in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "sha256": values})

    return paths.select("path").mapInPandas(digest, "path string, sha256 string")


def quick_hash_contents(contents: DataFrame, sample: int = V.QUICK_HASH_SAMPLE) -> DataFrame:
    """Adds ``quick_hash`` to rows that carry their content."""
    return contents.withColumn("quick_hash", quick_hash(F.col("content"), F.col("size"), sample))


def _members(source) -> list[zipfile.ZipInfo]:
    try:
        with zipfile.ZipFile(source) as archive:
            return [entry for entry in archive.infolist() if not entry.is_dir()]
    except (zipfile.BadZipFile, NotImplementedError, EOFError, ValueError, OSError):
        return []


def list_archive_entries(archives: DataFrame) -> DataFrame:
    """One row per member of each zip: archive_path, position, entry_name, entry_size.

    ``archives``: path, content. A damaged archive yields no rows.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, position, entry.filename, entry.file_size)
                    for path, content in zip(batch["path"], batch["content"])
                    for position, entry in enumerate(_members(io.BytesIO(content)))]
            yield pd.DataFrame(rows, columns=["archive_path", "position", "entry_name", "entry_size"])

    return archives.select("path", "content").mapInPandas(
        read, "archive_path string, position long, entry_name string, entry_size long")


def _member_bodies(source) -> Iterator[tuple[int, str, bytes]]:
    entries = _members(source)
    if not entries:
        return
    with zipfile.ZipFile(source) as archive:
        for position, entry in enumerate(entries):
            try:
                yield position, entry.filename, archive.read(entry)
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError):
                continue


def read_archive_members(archives: DataFrame) -> DataFrame:
    """Member contents: file_key, system_key, position, extension, content.

    ``archives``: file_key, system_key, and ``content`` or else ``path`` to read
    it from inside the tasks. An unreadable member yields no row.
    """
    held = "content" in archives.columns
    columns = ["file_key", "system_key", "position", "entry_name", "content"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held_bytes = [], 0
        for batch in batches:
            for key, system, given in zip(batch["file_key"], batch["system_key"], batch["given"]):
                for position, name, body in _member_bodies(io.BytesIO(given) if held else given):
                    rows.append((key, system, position, name, body))
                    held_bytes += len(body)
                    if held_bytes > BYTES_PER_BATCH or len(rows) >= ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held_bytes = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    rows = archives.select("file_key", "system_key", F.col("content" if held else "path").alias("given")).mapInPandas(
        read, "file_key string, system_key string, position long, entry_name string, content binary")
    return rows.withColumn("extension", extension_of(F.col("entry_name")))


def hash_archive_members(archives: DataFrame) -> DataFrame:
    """SHA-1 and CRC-32 of the members of zip archives: the columns of ``hash_files`` with position and entry_name.

    ``archives``: file_key, system_key, path. Members are streamed in blocks, so a member of any
    size needs little memory. An archive or member that cannot be read gives a row with ``failed``.
    """
    def list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, system, path in zip(batch["file_key"], batch["system_key"], map(local_path, batch["path"])):
                try:
                    with zipfile.ZipFile(path) as archive:
                        rows += [(key, system, path, position, entry.filename, entry.file_size, False)
                                 for position, entry in enumerate(e for e in archive.infolist() if not e.is_dir())]
                except (zipfile.BadZipFile, NotImplementedError, EOFError, ValueError, OSError):
                    rows.append((key, system, path, -1, None, 0, True))
            yield pd.DataFrame(rows, columns=["file_key", "system_key", "path", "position", "entry_name", "size", "unread"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, position, skip, unread in zip(batch["path"], batch["position"], batch["header_skip"], batch["unread"]):
                try:
                    if unread:
                        raise OSError(path)
                    with zipfile.ZipFile(path) as archive:
                        entry = [e for e in archive.infolist() if not e.is_dir()][position]
                        with archive.open(entry) as stream:
                            rows.append(_stream_digests(stream, skip))
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, ValueError, OSError):
                    rows.append((None, None, None, None, True))
            yield pd.concat([batch[["file_key", "system_key", "position", "entry_name", "size", "header_skip"]].reset_index(drop=True),
                             pd.DataFrame(rows, columns=["sha1", "crc32", "payload_sha1", "payload_crc32", "failed"])], axis=1)

    members = archives.select("file_key", "system_key", "path").mapInPandas(
        list_members, "file_key string, system_key string, path string, position long, entry_name string, size long, unread boolean")
    skip = F.coalesce(header_skip(F.col("system_key"), extension_of(F.col("entry_name")), F.col("size")), F.lit(0))
    return (members.withColumn("header_skip", skip.cast("int"))
            .mapInPandas(digest, "file_key string, system_key string, position long, entry_name string, size long, header_skip int, "
                                 "sha1 string, crc32 string, payload_sha1 string, payload_crc32 string, failed boolean")
            .withColumn("payload_size", F.when(F.col("header_skip") > 0, F.col("size") - F.col("header_skip"))))


def hash_files(files: DataFrame) -> DataFrame:
    """SHA-1 and CRC-32 of files of any size, raw and behind their copier header.

    ``files``: file_key, system_key, extension, path, size. Each file is streamed
    once inside its task; a file that cannot be read comes back with ``failed``.
    """
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_stream_hashes(path, skip) for path, skip in zip(batch["path"], batch["header_skip"])]
            yield pd.concat([batch[["file_key", "system_key", "size", "header_skip"]], pd.DataFrame(
                rows, columns=["sha1", "crc32", "payload_sha1", "payload_crc32", "failed"])], axis=1)

    skip = header_skip(F.col("system_key"), F.col("extension"), F.col("size"))
    return (files.select("file_key", "system_key", "path", "size", skip.alias("header_skip"))
            .mapInPandas(digest, "file_key string, system_key string, size long, header_skip int, sha1 string, "
                                 "crc32 string, payload_sha1 string, payload_crc32 string, failed boolean")
            .withColumn("payload_size", F.when(F.col("header_skip") > 0, F.col("size") - F.col("header_skip"))))


def _stream_hashes(path: str, skip: int) -> tuple:
    path = local_path(path)
    try:
        with open(path, "rb") as stream:
            return _stream_digests(stream, skip)
    except OSError:
        return None, None, None, None, True


def _stream_digests(stream, skip: int, block: int = 1 << 20) -> tuple:
    whole, body = hashlib.sha1(), hashlib.sha1()
    head = stream.read(skip)
    whole.update(head)
    whole_crc, body_crc = zlib.crc32(head), 0
    while piece := stream.read(block):
        whole.update(piece)
        whole_crc = zlib.crc32(piece, whole_crc)
        if skip:
            body.update(piece)
            body_crc = zlib.crc32(piece, body_crc)
    return (whole.hexdigest().upper(), f"{whole_crc:08X}",
            body.hexdigest().upper() if skip else None, f"{body_crc:08X}" if skip else None, False)


def package_titles(markers: DataFrame) -> DataFrame:
    """marker_path and title from package metadata; null where it is missing or damaged.

    ``markers``: path, content. The binary index is read with column functions:
    a 20-byte header, then one 16-byte entry per field.
    """
    def number(content, offset, width: int):
        # Little-endian: turn the bytes round, then read them as hexadecimal.
        piece = F.hex(F.substring(content, offset.cast("int") + 1, F.lit(width)))
        turned = F.concat(*[F.substring(piece, 2 * (width - n) - 1, 2) for n in range(width)])
        return F.conv(turned, 16, 10).cast("long")

    content, size = F.col("content"), F.length("content").cast("long")
    header_ok = (size >= 20) & (F.hex(F.substring("content", 1, 4)) == "00505346")
    head = markers.select(F.col("path").alias("marker_path"), "content", size.alias("size"),
                          F.when(header_ok, number(content, F.lit(8), 4)).alias("keys_at"),
                          F.when(header_ok, number(content, F.lit(12), 4)).alias("data_at"),
                          F.when(header_ok, number(content, F.lit(16), 4)).alias("entries"))
    # The content's own length bounds the number of entries.
    usable = (F.col("entries") >= 1) & (F.col("size") >= 20 + 16 * F.col("entries"))

    def entry(index):
        at = F.lit(20) + index * 16
        return F.struct(number(content, at, 2).alias("key_at"), number(content, at + 2, 2).alias("kind"),
                        number(content, at + 4, 4).alias("length"), number(content, at + 12, 4).alias("value_at"))

    fields = F.transform(F.sequence(F.lit(0).cast("long"), F.col("entries") - 1), entry)
    named = F.filter(fields, lambda f: (f["kind"] == 0x0204) & F.startswith(
        F.concat(F.substring(content, (F.col("keys_at") + f["key_at"] + 1).cast("int"), F.lit(6)), F.unhex(F.lit("00"))),
        F.concat(F.encode(F.lit("TITLE"), "UTF-8"), F.unhex(F.lit("00")))))
    rows = head.withColumn("field", F.when(usable, F.try_element_at(named, F.lit(1))))
    raw = F.substring(content, (F.col("data_at") + F.col("field.value_at") + 1).cast("int"),
                      F.col("field.length").cast("int"))
    text = F.regexp_replace(F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\x00+\z", ""),
                            r"(?U)^\s+|\s+\z", "")
    return rows.select("marker_path", F.when(text != "", text).alias("package_title"))


def read_package_titles(spark: SparkSession, root: str) -> DataFrame:
    return package_titles(read_contents(spark, root, V.PACKAGE_MARKER))
