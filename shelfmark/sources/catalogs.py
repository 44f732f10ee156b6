"""Platform dimension files and checksum catalogs."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import base_name, is_blank, normalise_extension, strip_blanks
from shelfmark.model import CATALOG_ROW_SCHEMA
from shelfmark.sources.catalog_chunks import CHUNK, parse_chunks, read_chunks

#: Rows a reader hands over at a time.
ROWS_PER_BATCH = 10_000

SYSTEMS_JSON = ("array<struct<key:string,name:string,manufacturer:string,category:string,enabled:boolean,"
                "formats:array<struct<extension:string,formatName:string,formatType:string,priority:int,"
                "requiresHeaderCheck:boolean,isArchive:boolean,isMultiFile:boolean>>>>")


def parse_systems(texts: DataFrame) -> DataFrame:
    """JSON text (one array of systems per row, column ``value``) → one row per format.

    Positions follow the order of the file; they break ties in identification.
    """
    systems = texts.select(F.posexplode(F.from_json("value", SYSTEMS_JSON)).alias("at", "system"))
    formats = systems.select("at", "system", F.posexplode_outer("system.formats").alias("place", "format"))
    return formats.select(
        (F.col("at") + 1).alias("system_position"), (F.col("place") + 1).alias("format_position"),
        F.col("system.key").alias("system_key"), F.col("system.name").alias("system_name"),
        F.col("system.manufacturer").alias("manufacturer"), F.col("system.category").alias("category"),
        F.coalesce("system.enabled", F.lit(True)).alias("enabled"),
        normalise_extension(F.col("format.extension")).alias("extension"),
        F.col("format.formatName").alias("format_name"), F.col("format.formatType").alias("format_type"),
        F.coalesce("format.priority", F.lit(0)).alias("priority"),
        F.coalesce("format.requiresHeaderCheck", F.lit(False)).alias("requires_header_check"),
        F.coalesce("format.isArchive", F.lit(False)).alias("is_archive"),
        F.coalesce("format.isMultiFile", F.lit(False)).alias("is_multi_file"))


def load_systems(spark: SparkSession, path: str) -> DataFrame:
    """Read a platform file (a JSON array) as one row per format."""
    return parse_systems(spark.read.text(path, wholetext=True))


def _clean_hash(value: Column) -> Column:
    return F.when(~is_blank(value), F.upper(strip_blanks(value)))


_ROM = "struct<_name:string,_size:string,_crc:string,_md5:string,_sha1:string,_sha256:string>"
# Children that are neither of these come as the text of what they hold.
_GAME = f"_name string, description string, rom array<{_ROM}>, disk array<{_ROM}>, xs_any array<string>"
# That text is written anew by the reader: one space before an attribute, double quotes around its plain value. A value ends at a quote
# that the next attribute or the end of the tag follows.
_VALUE = r'"(?:.*?)"(?= [\w:.-]+="|>)'
_NESTED = rf'(?s)<(?:[\w.-]+:)?(?:rom|disk)((?: [\w:.-]+={_VALUE})*)>'


def _nested_roms(held: Column) -> Column:
    """The rom and disk elements at any depth of a text, in order."""
    def attribute(tag: Column, name: str) -> Column:
        # Null where the attribute is not there, which is not the same as an empty one.
        return F.try_element_at(F.regexp_extract_all(F.concat(tag, F.lit(">")), F.lit(rf'(?s) {name}="(.*?)"(?= [\w:.-]+="|>)'), F.lit(1)), F.lit(1))

    names = ("name", "size", "crc", "md5", "sha1", "sha256")
    return F.transform(F.regexp_extract_all(held, F.lit(_NESTED), F.lit(1)),
                       lambda tag: F.struct(*[attribute(tag, name).alias(f"_{name}") for name in names]))


def read_catalog_xml(spark: SparkSession, path: str) -> DataFrame:
    """Logiqx-style XML catalogs → catalog rows, with rom and disk elements at any depth of a game. One distributed read per row tag.

    Below a game's direct children, an attribute value that itself holds a quote followed by what looks like
    the end of a tag is cut there.
    """
    parts = []
    for kind, tag in enumerate(("game", "machine", "software")):
        rows = (spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(_GAME).load(path)
                .select("*", F.col("_metadata.file_path").alias("source_file"),
                        F.col("_metadata.file_block_start").alias("block"))
                .withColumn("row", F.monotonically_increasing_id())
                .withColumn("kind", F.lit(kind)))
        none = F.array().cast(f"array<{_ROM}>")
        nested = F.flatten(F.transform(F.coalesce("xs_any", F.array().cast("array<string>")), _nested_roms))
        roms = F.concat(F.coalesce("rom", none), F.coalesce("disk", none), F.coalesce(nested, none))
        name = F.coalesce("_name", "description", F.lit("Unknown"))
        parts.append(rows.select("source_file", "kind", "block", "row", name.alias("name"),
                                 F.posexplode(roms).alias("place", "rom")))
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # Order inside a file: kind of row, block, row in the block, place in the game.
    return merged.select(
        base_name(F.col("source_file")).alias("source_file"),
        F.struct("kind", "block", "row", "place").alias("position"), "name",
        F.coalesce("rom._name", "name").alias("rom_name"),
        F.coalesce(strip_blanks(F.col("rom._size")).try_cast("long"), F.lit(0)).alias("size"),
        _clean_hash(F.col("rom._crc")).alias("crc32"), _clean_hash(F.col("rom._md5")).alias("md5"),
        _clean_hash(F.col("rom._sha1")).alias("sha1"), _clean_hash(F.col("rom._sha256")).alias("sha256"))


# A quoted text (with \" for a quote), a bracket, or a bare word.
_TOKEN = re.compile(r'"((?:\\"|[^"])*)(?:"|\Z)|([()])|([^\s()"][^\s()]*)')


def _rom_rows(game: dict) -> Iterator[tuple]:
    """Finished game block → one tuple per rom or disk it holds directly."""
    name = game["fields"].get("name", game["fields"].get("description", "Unknown"))
    for rom in game["roms"]:
        yield (rom.get("name", name), name, *(rom.get(key) for key in ("size", "crc", "md5", "sha1", "sha256")))


def _catalog_records(text: str) -> Iterator[tuple]:
    """(rom name, game name, size, crc, md5, sha1, sha256) per rom or disk block.

    One pass with a stack of open blocks. A block only opens below a ``game`` or
    ``machine``; a file that breaks off still yields what it held.
    """
    open_blocks: list[dict] = []
    word_before: str | None = None

    def close() -> Iterator[tuple]:
        block = open_blocks.pop()
        if not open_blocks:
            yield from _rom_rows(block)
        elif len(open_blocks) == 1 and block["kind"] in ("rom", "disk"):
            open_blocks[0]["roms"].append(block["fields"])

    for match in _TOKEN.finditer(text):
        quoted, bracket, word = match.groups()
        key, word_before = word_before, None
        if bracket == "(":
            if key is not None and (open_blocks or key in ("game", "machine")):
                open_blocks.append({"kind": key.lower(), "fields": {}, "roms": []})
        elif bracket == ")":
            if open_blocks:
                yield from close()
        elif key is not None and open_blocks:
            open_blocks[-1]["fields"][key.lower()] = quoted.replace('\\"', '"') if word is None else word
        else:
            word_before = word
    while open_blocks:
        yield from close()


def parse_catalog_text(texts: DataFrame) -> DataFrame:
    """ClrMamePro text catalogs → catalog rows.

    ``texts``: source_file, value (one whole catalog per row). Nested brackets
    are no regular language, so each file is read by a small helper in the tasks.
    """
    columns = ["source_file", "position", "rom_name", "name", "size", "crc32", "md5", "sha1", "sha256"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = ((source, position, *record) for source, text in zip(batch["source_file"], batch["value"])
                     if text is not None and not text.lstrip().startswith("<")
                     for position, record in enumerate(_catalog_records(text)))
            while rows := list(itertools.islice(found, ROWS_PER_BATCH)):
                yield pd.DataFrame(rows, columns=columns)

    raw_schema = ("source_file string, position long, rom_name string, name string, size string, "
                  "crc32 string, md5 string, sha1 string, sha256 string")
    raw = texts.select("source_file", "value").mapInPandas(read, raw_schema)
    return raw.select("source_file", "position", "name", "rom_name",
                      F.coalesce(strip_blanks(F.col("size")).try_cast("long"), F.lit(0)).alias("size"),
                      *[_clean_hash(F.col(name)).alias(name) for name in ("crc32", "md5", "sha1", "sha256")])


def read_catalog_text(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The text catalogs below ``path``, in chunks of about ``chunk`` characters: a file of any size is read by many tasks."""
    raw = parse_chunks(read_chunks(spark, path, chunk)).withColumnRenamed("crc", "crc32")
    return raw.select("source_file", "position", "name", "rom_name",
                      F.coalesce(strip_blanks(F.col("size")).try_cast("long"), F.lit(0)).alias("size"),
                      *[_clean_hash(F.col(name)).alias(name) for name in ("crc32", "md5", "sha1", "sha256")])


def read_catalogs(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Both kinds of catalog files below ``path`` with their system key.

    ``sources``: system_key, catalog_file. Text and XML readers each skip the
    other's files.
    """
    text = read_catalog_text(spark, path).withColumn("position", F.struct(
        F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), F.col("position").alias("row"), F.lit(0).alias("place")))
    rows = text.unionByName(read_catalog_xml(spark, path))
    named = rows.withColumn("catalog_file", F.url_decode("source_file"))
    return named.join(sources.select("system_key", "catalog_file"), "catalog_file").drop("catalog_file")


CATALOG_COLUMNS = CATALOG_ROW_SCHEMA.fieldNames()
