"""Table shapes and the platform dimension.

Natural keys are used throughout: ``file_key`` is the upper-cased path and
``game_key`` is ``<system key>:<normalised title>``. No auto-increment ids are
needed, so every job can run in parallel without coordination.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfmark.fixed_values import CATALOG_TABLE, PLATFORM_TABLE

LISTING_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("file_name", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("created", T.TimestampType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("is_directory", T.BooleanType()),
    T.StructField("marker_path", T.StringType()),
    T.StructField("location", T.StringType()),
])

SYSTEM_SCHEMA = T.StructType([
    T.StructField("system_position", T.IntegerType()),
    T.StructField("system_key", T.StringType()),
    T.StructField("system_name", T.StringType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
])

FORMAT_SCHEMA = T.StructType([
    T.StructField("system_position", T.IntegerType()),
    T.StructField("format_position", T.IntegerType()),
    T.StructField("system_key", T.StringType()),
    T.StructField("system_name", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("format_name", T.StringType()),
    T.StructField("format_type", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("requires_header_check", T.BooleanType()),
    T.StructField("is_archive", T.BooleanType()),
    T.StructField("is_multi_file", T.BooleanType()),
])

CATALOG_ROW_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("position", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("rom_name", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("crc32", T.StringType()),
    T.StructField("md5", T.StringType()),
    T.StructField("sha1", T.StringType()),
    T.StructField("sha256", T.StringType()),
])


@lru_cache(maxsize=1)
def platform_rows() -> tuple[tuple, tuple]:
    """The built-in platform table as (system rows, format rows)."""
    systems, formats = [], []
    for line in PLATFORM_TABLE.strip().splitlines():
        cells = [cell.strip() for cell in line.split(" | ")]
        if line.startswith(" "):
            system = systems[-1]
            formats.append((system[0], len(formats) + 1, system[1], system[2],
                            cells[0], cells[1], cells[2], int(cells[3]),
                            "header-check" in cells[4:], "archive" in cells[4:],
                            "multi-file" in cells[4:]))
        else:
            systems.append((len(systems) + 1, *cells, True))
    return tuple(systems), tuple(formats)


@lru_cache(maxsize=1)
def catalog_sources() -> tuple:
    """(system key, folder, file name, display source) per catalogued platform."""
    return tuple(tuple(cell.strip() for cell in line.split(" | "))
                 for line in CATALOG_TABLE.strip().splitlines())


def builtin_systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(platform_rows()[0]), SYSTEM_SCHEMA)


def builtin_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(platform_rows()[1]), FORMAT_SCHEMA)


def builtin_catalog_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(catalog_sources()),
        "system_key string, catalog_folder string, catalog_file string, catalog_source string")
