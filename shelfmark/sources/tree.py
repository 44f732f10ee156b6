"""Directory trees listed inside the tasks, level by level, with the paths that could not be read."""

from __future__ import annotations

import errno
import math
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import base_name, extension_of
from shelfmark.session import scratch_path
from shelfmark.sources.paths import mounted

#: Folders (or ranges of names) that one task lists; names of one folder that are inspected together; rows handed over at a time.
FOLDERS_PER_TASK, NAMES_PER_RANGE, ROWS_PER_BATCH = 64, 20_000, 10_000

FOUND = "kind string, location string, path string, names array<string>, size long, modified long, problem string, recursive boolean"
FOLDER, FILE, PROBLEM = "folder", "file", "problem"


@dataclass(frozen=True)
class TreeListing:
    """``files``: listing rows. ``problems``: location, path, problem (one row per path that could not be read)."""
    files: DataFrame
    problems: DataFrame


def _is_text(path: str) -> bool:
    try:
        path.encode()
    except UnicodeEncodeError:
        return False
    return True


def _inspect(location: str, path: str, recursive: bool) -> tuple | None:
    """One row for an entry of a folder; None for what is gone, skipped, or neither file nor folder."""
    if not _is_text(path):
        return PROBLEM, location, path.encode("utf-8", "replace").decode(), None, None, None, "name is not UTF-8"
    try:
        info = os.stat(path)
        if stat.S_ISREG(info.st_mode):
            return FILE, location, path, None, info.st_size, info.st_mtime_ns // 1000, None
        if stat.S_ISDIR(info.st_mode) and recursive and not _leads_back(path):
            return FOLDER, location, path, None, None, None, None
    except FileNotFoundError:
        return None
    except OSError as error:
        return PROBLEM, location, path, None, None, None, errno.errorcode.get(error.errno, "error")
    return None


def _leads_back(path: str) -> bool:
    """A link to a folder above itself would be listed for ever."""
    if not os.path.islink(path):
        return False
    target, above = os.path.realpath(path), os.path.realpath(os.path.dirname(path))
    return (above + "/").startswith(target.rstrip("/") + "/")


def _entries(location: str, path: str, names, recursive: bool) -> Iterator[tuple]:
    """Rows of one folder, or of one range of its names."""
    if names is not None:
        for name in names:
            if (row := _inspect(location, os.path.join(path, name), recursive)) is not None:
                yield row
        return
    later: list[str] = []
    try:
        with os.scandir(path) as entries:
            for n, entry in enumerate(entries):
                # A very wide folder: names are cheap, inspecting them is not, so the rest goes to other tasks.
                if n >= NAMES_PER_RANGE and _is_text(entry.name):
                    later.append(entry.name)
                    if len(later) == NAMES_PER_RANGE:
                        yield FOLDER, location, path, later, None, None, None
                        later = []
                elif (row := _inspect(location, os.path.join(path, entry.name), recursive)) is not None:
                    yield row
    except OSError as error:
        yield PROBLEM, location, path, None, None, None, errno.errorcode.get(error.errno, "error")
    if later:
        yield FOLDER, location, path, later, None, None, None


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in FOUND.split(", ")]
    rows: list[tuple] = []

    def frame() -> pd.DataFrame:
        # Whole numbers stay whole beside missing ones.
        return pd.DataFrame(rows, columns=columns).astype({"size": "Int64", "modified": "Int64"})

    for batch in batches:
        for location, path, names, recursive in zip(batch["location"], batch["path"], batch["names"], batch["recursive"]):
            for row in _entries(location, path, names, recursive):
                rows.append((*row, recursive))
                if len(rows) >= ROWS_PER_BATCH:
                    yield frame()
                    rows.clear()
    if rows:
        yield frame()


def list_trees(locations: DataFrame) -> TreeListing:
    """Every file below the given folders, and every path that could not be read.

    ``locations``: location (a mounted folder), recursive. Each round lists one level of folders in the tasks and
    stores what it found; the folders among that are the next round's, spread anew, so the driver
    sees counts only and a lost executor costs part of one level. The names of a very wide folder beyond the first range are handed on
    as ranges. Links are followed, but not to a folder above themselves. A folder that cannot
    be opened (a missing location, too), an entry that cannot be inspected and a name that is not UTF-8 are problems; an entry that vanishes
    meanwhile is none. Pipes and devices are left out. Rows with a null location are left out.
    """
    spark = locations.sparkSession
    levels: list[str] = []
    wanted = locations.filter("location IS NOT NULL").groupBy("location").agg(F.max("recursive").alias("recursive"))
    frontier = wanted.select("location", mounted(F.col("location")).alias("path"), F.lit(None).cast("array<string>").alias("names"), "recursive")
    while count := frontier.count():
        path = scratch_path(spark, "tree-level")
        spread = frontier.repartition(max(1, math.ceil(count / FOLDERS_PER_TASK)))
        spread.mapInPandas(_list_level, FOUND).write.parquet(path)
        levels.append(path)
        frontier = spark.read.schema(FOUND).parquet(path).filter(F.col("kind") == FOLDER).select("location", "path", "names", "recursive")
    found = spark.read.schema(FOUND).parquet(*levels) if levels else spark.createDataFrame([], FOUND)
    files = found.filter(F.col("kind") == FILE).select(
        "path", base_name(F.col("path")).alias("file_name"), extension_of(base_name(F.col("path"))).alias("extension"), "size",
        F.lit(None).cast("timestamp").alias("created"), F.timestamp_micros("modified").alias("modified"), "location")
    return TreeListing(files, found.filter(F.col("kind") == PROBLEM).select("location", "path", "problem"))
