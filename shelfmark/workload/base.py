"""The driver tables seen as a media library, and the registry of queries.

A query is one function (tables) → DataFrame plus, where SQL can say it, the
equivalent SQL over the same whole tables. Views shared by both sides are
written once, in SQL that Spark and other ANSI engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from shelfmark import model


def choose(column: str, values: list[str]) -> str:
    """CASE that spreads the given texts over the values of an integer column."""
    arms = " ".join(f"WHEN {n} THEN '{value}'" for n, value in enumerate(values))
    return f"CASE {column} % {len(values)} {arms} END"


SYSTEM_KEYS = [row[1] for row in model.platform_rows()[0]]
TAGS = ["(USA)", "(Europe)", "(Japan)", "(World)", "(USA, Europe)", "(Beta 2) (USA)", "[b1]", ""]
REGION_TEXT = ["USA", "Europe", "Japan", "World", "USA, Europe", "USA", "", ""]
EXTENSIONS = [".nes", ".sfc", ".zip", ".cue", ".bin", ".iso", ".md"]

# lineitem rows as library files. (order, line, part, supplier) is unique.
FILES_VIEW = f"""
SELECT upper(path) AS file_key, path, file_name, extension, size, modified, location, game_key, part_key,
  region, '' AS language, revision, CAST(NULL AS STRING) AS version, 'Image' AS format_name,
  status, catalog_status,
  CASE WHEN catalog_status = 'Verified' THEN 'Checksum catalog' END AS catalog_source,
  CASE WHEN catalog_status = 'Verified' AND tax > 0.02
       THEN 'Item ' || CAST(part_key AS STRING) || CASE WHEN tax > 0.05 THEN ' (Japan)' ELSE ' (USA) (Rev 1)' END
       END AS catalog_name,
  is_preferred, is_manual, is_excluded, confidence,
  CASE WHEN extension IN ('.cue', '.bin') THEN 'Disc ' || CAST(1 + supplier % 2 AS STRING) END AS file_group,
  'Q' || CAST(size % 1000 AS STRING) AS quick_hash, false AS is_directory
FROM (
  SELECT *, location || '/' || CAST(game_key AS STRING) || '/' || file_name AS path
  FROM (
    SELECT l_orderkey AS game_key, l_partkey AS part_key, l_suppkey AS supplier, l_tax AS tax,
      '/shelf' || CAST(l_suppkey % 10 AS STRING) AS location,
      {choose('(l_linenumber - 1)', EXTENSIONS)} AS extension,
      'Item ' || CAST(l_partkey AS STRING) || ' ' || {choose('l_suppkey', TAGS)} || '-'
        || CAST(l_linenumber AS STRING) || '-' || CAST(l_suppkey AS STRING)
        || {choose('(l_linenumber - 1)', EXTENSIONS)} AS file_name,
      {choose('l_suppkey', REGION_TEXT)} AS region,
      CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_shipdate AS modified,
      CASE WHEN l_quantity > 40 THEN 'Rev 1' WHEN l_quantity > 30 THEN '' END AS revision,
      CASE WHEN l_returnflag = 'N' THEN 'Missing' WHEN l_returnflag = 'R' THEN 'Duplicate'
           WHEN l_discount = 0 THEN 'Corrupt' ELSE 'Normal' END AS status,
      CASE WHEN l_linestatus = 'F' THEN 'Verified' WHEN l_tax < 0.02 THEN 'Unknown' WHEN l_tax < 0.04 THEN 'NoMatch'
           WHEN l_tax < 0.06 THEN 'Error' ELSE 'Unsupported' END AS catalog_status,
      l_linenumber = 1 AS is_preferred, l_discount = 0.1 AS is_manual, l_tax = 0.08 AS is_excluded,
      CAST(CASE WHEN l_discount < 0.03 THEN 0.5 WHEN l_discount < 0.07 THEN 0.8 ELSE 0.95 END AS DOUBLE) AS confidence
    FROM {{lineitem}}) a) b
"""

# orders as games.
GAMES_VIEW = f"""
SELECT game_key, system_key, title,
  CASE WHEN upper(substr(title, 1, 4)) = 'THE ' THEN substr(title, 5) || ', The' ELSE title END
    AS sort_title,
  regexp_replace(lower(title), '[^a-z0-9]', ''{{all}}) AS normalised_title, is_wanted
FROM (SELECT o_orderkey AS game_key, {choose('o_custkey', SYSTEM_KEYS)} AS system_key,
        CASE WHEN o_orderstatus = 'P' THEN 'The ' ELSE '' END || 'Order ' || o_orderpriority || ' '
          || CAST(o_custkey AS STRING) AS title, o_orderstatus = 'O' AS is_wanted
      FROM {{orders}}) a
"""

# parts as games: one system per brand, so titles repeat inside systems.
PART_GAMES_VIEW = """
SELECT p_partkey AS game_key, p_brand AS system_key, p_name AS title, p_name AS sort_title,
  regexp_replace(lower(p_name), '[^a-z0-9]', ''{all}) AS normalised_title, p_size < 10 AS is_wanted,
  p_type AS kind, p_size AS size
FROM {part}
"""

# parts again, with catalogue ranks and tags in their titles.
RANKED_GAMES_VIEW = """
SELECT p_partkey AS game_key, p_brand AS system_key, title, title AS sort_title,
  regexp_replace(lower(title), '[^a-z0-9]', ''{all}) AS normalised_title, false AS is_wanted
FROM (SELECT *, CASE
    WHEN p_size < 10 THEN '00' || CAST(p_size AS STRING) || ' - ' || p_name || ' (USA) [!]'
    WHEN p_size < 20 THEN '0' || CAST(p_size * 10 AS STRING) || ' ' || p_name
    WHEN p_size < 22 THEN CAST(p_size * 50 AS STRING) || ' ' || p_name || ' (Japan)'
    WHEN p_size < 25 THEN '(Demo) [b]' ELSE p_name || ' (Proto)' END AS title
  FROM {part}) a
"""

# part names as file names of the usual naming convention.
NAMES_VIEW = """
SELECT p_partkey AS part_key, p_brand AS system_key, '/names/' || p_brand || '/' || file_name AS path, file_name
FROM (SELECT *, CASE p_size % 8
    WHEN 0 THEN p_name || ' (USA) (Rev 1) [!].sfc'
    WHEN 1 THEN p_name || ' (USA, Europe) (En,Ja,En).gba'
    WHEN 2 THEN p_name || ' (Disc ' || CAST(p_size AS STRING) || ').cue'
    WHEN 3 THEN p_name || ' CD1 (Track 0' || CAST(p_size AS STRING) || ').bin'
    WHEN 4 THEN 'The_' || p_name || '_(japan)_(Version 1.2-b)_[T+Fr] - .zip'
    WHEN 5 THEN '(' || p_name || ') [' || p_type || '].iso'
    WHEN 6 THEN p_name || ' (v1.0) (v2.0) (Revision A, World,World).md'
    ELSE p_name || '. - (Fr, de ,XX).tar.gz' END AS file_name
  FROM {part}) a
"""


# Tables whose rows are turned into files, games or contents.
WIDE_TABLES = {"lineitem", "orders", "part", "documents", "pages"}


class Tables:
    """Parquet tables of one folder, and the library views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return rows

    def view(self, text: str) -> DataFrame:
        names = [n for n in ("lineitem", "orders", "part", "documents") if "{" + n + "}" in text]
        return self.spark.sql(text.replace("{all}", ""), **{name: getattr(self, name) for name in names})

    @cached_property
    def files(self) -> DataFrame:
        return self.view(FILES_VIEW)

    @cached_property
    def games(self) -> DataFrame:
        return self.view(GAMES_VIEW)

    @cached_property
    def part_games(self) -> DataFrame:
        return self.view(PART_GAMES_VIEW)

    @cached_property
    def part_files(self) -> DataFrame:
        files = self.files
        return files.drop("game_key").withColumnRenamed("part_key", "game_key")

    @cached_property
    def ranked_games(self) -> DataFrame:
        return self.view(RANKED_GAMES_VIEW)

    @cached_property
    def names(self) -> DataFrame:
        return self.view(NAMES_VIEW)

    @cached_property
    def systems(self) -> DataFrame:
        return model.builtin_systems(self.spark)

    @cached_property
    def formats(self) -> DataFrame:
        return model.builtin_formats(self.spark)

    @cached_property
    def brands(self) -> DataFrame:
        """The brands as systems."""
        return self.spark.sql("SELECT DISTINCT p_brand AS system_key, 'Maker ' || p_brand AS system_name FROM {part}",
                              part=self.part)


def _values(rows, names: str) -> str:
    def cell(value):
        if isinstance(value, bool):
            return str(value).lower()
        return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(cell(value) for value in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


def _ansi(text: str) -> str:
    for name in ("lineitem", "orders", "part", "documents"):
        text = text.replace("{" + name + "}", name)
    return text.replace("{all}", ", 'g'").strip()


CTES = {
    "files": _ansi(FILES_VIEW),
    "games": _ansi(GAMES_VIEW),
    "part_games": _ansi(PART_GAMES_VIEW),
    "part_files": "SELECT * EXCLUDE (game_key, part_key), part_key AS game_key FROM files",
    "ranked_games": _ansi(RANKED_GAMES_VIEW),
    "names": _ansi(NAMES_VIEW),
    "systems": _values(model.platform_rows()[0], "system_position, system_key, system_name, manufacturer, category, enabled"),
    "formats": _values(model.platform_rows()[1],
                       "system_position, format_position, system_key, system_name, extension, format_name, "
                       "format_type, priority, requires_header_check, is_archive, is_multi_file"),
    "brands": "SELECT DISTINCT p_brand AS system_key, 'Maker ' || p_brand AS system_name FROM part",
}
CTE_NEEDS = {"part_files": ["files"]}


MATERIALISED = {"edges", "roots", "survivors", "remap", "moved", "redo"}


def with_ctes(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """SQL text with the named shared views, then ``extra`` ones, in front."""
    ordered: list[str] = []
    for name in names.split():
        for needed in [*CTE_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    blocks = [f"{name} AS ({CTES[name]})" for name in ordered]
    # Steps of several readers are worked out once; a recursive one cannot carry the hint.
    blocks += [f"{name} AS {'MATERIALIZED ' if name in MATERIALISED else ''}({text})" for name, text in (extra or {}).items()]
    return (f"WITH {', '.join(blocks)} " if blocks else "") + body


Query = Callable[[Tables], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (function, sql)
        return function
    return register
