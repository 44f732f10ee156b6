"""Column expressions over file names and titles. All JVM-side, no Python UDF."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.fixed_values import (ARTWORK_FORBIDDEN, FOLDER_FORBIDDEN,
                                    LANGUAGES, REGIONS)

# Fixed patterns. Blanks and digits are meant in the Unicode sense, spelled out
# because that is much faster than the flag; ``\\z`` is the true end of the text.
_S = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TAG = r"\(([^)]*)\)|\[([^\]]*)\]"
REVISION = rf"(?i)^(Rev(?:ision)?{_S}*[A-Z0-9.]+)$"
VERSION = rf"(?iU)^(?:v|Version{_S}*)[0-9][\w.\-]*$"
DISC = rf"(?i)(?:Disc|Disk|CD){_S}*0*([0-9]+)"
TRACK = rf"(?i)Track{_S}*0*([0-9]+)"
SEPARATOR = rf"{_S}{{2,}}|{_S}+-{_S}*$"
OUTER_BLANKS = rf"^{_S}+|{_S}+\z"
RANK_PREFIX = rf"^0\p{{Nd}}{{2,5}}(?:{_S}|-)+"
ANY_NUMBER_PREFIX = rf"^\p{{Nd}}{{2,5}}(?:{_S}|-)+"
_ONE_TAG = r"[\(\[][^()\[\]]*[\)\]]"
TRAILING_TAGS = rf"(?:{_S}*{_ONE_TAG}{_S}*)+\z"
FIRST_TAG_TAIL = rf"^({_S}*{_ONE_TAG})(?:{_S}*{_ONE_TAG}{_S}*)+\z"


def strip_blanks(text: Column) -> Column:
    """Trim every kind of blank, not only the space character."""
    return F.regexp_replace(text, OUTER_BLANKS, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip_blanks(text) == "")


def fold_case(text: Column) -> Column:
    """Case-insensitive key. Upper case, so ``_`` sorts after the letters."""
    return F.upper(text)


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the text holds one of the words, in any case; one pass over the text."""
    return text.rlike("(?i)" + "|".join(re.escape(word) for word in words))


def extension_of(name: Column) -> Column:
    """Lower-case extension with its dot; ``""`` without one."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)\z", 1))


def normalise_extension(extension: Column) -> Column:
    lowered = F.lower(extension)
    return F.when(lowered.startswith("."), lowered).otherwise(F.concat(F.lit("."), lowered))


def parent_of(path: Column) -> Column:
    """What stands before the last slash; a path without one as it is."""
    return F.when(F.contains(path, F.lit("/")), F.left(path, F.length(path) - F.length(base_name(path)) - 1)).otherwise(path)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def name_stem(name: Column) -> Column:
    """Name without its last extension, underscores as blanks, trimmed."""
    return strip_blanks(F.translate(F.regexp_replace(name, r"\.[^.]*\z", ""), "_", " "))


def _tokens(stem: Column) -> Column:
    """All comma-separated words inside the tags of a name, in order."""
    tags = F.regexp_extract_all(stem, F.lit(TAG), F.lit(0))
    words = F.flatten(F.transform(tags, lambda tag: F.split(F.substring(tag, F.lit(2), F.length(tag) - 2), ",", -1)))
    return (F.when(stem.rlike(r"[(\[]"), F.filter(F.transform(words, strip_blanks), lambda word: word != ""))
            .otherwise(F.array().cast("array<string>")))


def _word_kind(word: Column) -> Column:
    folded = F.upper(word)
    return (F.when(folded.isin([region.upper() for region in REGIONS]), "region")
            .when(folded.isin([language.upper() for language in LANGUAGES]), "language")
            .when(word.rlike(REVISION), "revision").when(word.rlike(VERSION), "version").otherwise("tag"))


def bare_title(stem: Column) -> Column:
    """The stem without tags, disc and track; the stem itself where nothing is left."""
    title = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, TAG, " "), DISC, " "), TRACK, " ")
    return F.regexp_replace(F.regexp_replace(title, SEPARATOR, " "), r"^[ .\-]+|[ .\-]+\z", "")


def with_parsed_name(rows: DataFrame, name: Column) -> DataFrame:
    """Adds ``parsed``: title, regions, languages, revision, version, disc, track and other tags.

    Worked in steps, so that the stem and its classified words are made once per
    row however many fields are taken from them.
    """
    language_map = F.create_map(*[F.lit(cell) for pair in LANGUAGES.items()
                                  for cell in (pair[0].upper(), pair[1])])
    steps = rows.withColumn("__stem", name_stem(name))
    steps = steps.withColumn("__words", F.transform(_tokens(F.col("__stem")), lambda word: F.struct(
        _word_kind(word).alias("kind"), word.alias("word")))).withColumn("__bare", bare_title(F.col("__stem")))

    def of_kind(wanted: str) -> Column:
        return F.transform(F.filter("__words", lambda entry: entry["kind"] == wanted), lambda entry: entry["word"])

    return steps.withColumn("parsed", F.struct(
        F.when(is_blank(F.col("__bare")), F.col("__stem")).otherwise(F.col("__bare")).alias("title"),
        F.array_distinct(of_kind("region")).alias("regions"),
        F.array_distinct(F.transform(of_kind("language"), lambda word: language_map[F.upper(word)])).alias("languages"),
        F.try_element_at(of_kind("revision"), F.lit(-1)).alias("revision"),
        F.try_element_at(of_kind("version"), F.lit(-1)).alias("version"),
        disc_number(F.col("__stem")).alias("disc_number"), track_number(F.col("__stem")).alias("track_number"),
        of_kind("tag").alias("tags"))).drop("__stem", "__words", "__bare")


def disc_number(stem: Column) -> Column:
    return F.regexp_extract(stem, DISC, 1).try_cast("int")


def track_number(stem: Column) -> Column:
    return F.regexp_extract(stem, TRACK, 1).try_cast("int")


@lru_cache(maxsize=1)
def _letter_map() -> tuple[str, str]:
    """Accented letter → base letter, derived from Unicode decomposition.

    Only characters that decompose to exactly one letter or digit are mapped;
    marks vanish in the clean-up that follows and Hangul has its own rule.
    Every upper-case letter whose lower case depends on context is settled here.
    """
    sources, targets = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        kept = [c for c in unicodedata.normalize("NFD", char)
                if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"]
        if len(kept) != 1 or ord(kept[0]) > 0xFFFF:
            continue
        lowered = kept[0].lower() if len(kept[0].lower()) == 1 else kept[0]
        if kept[0] != char or lowered == "σ":
            sources.append(char)
            targets.append(lowered)
    return "".join(sources), "".join(targets)


def _split_hangul(text: Column) -> Column:
    """Composed Hangul syllables → their two or three letters."""
    def letter(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def syllable(char: Column) -> Column:
        index = F.ascii(char) - 0xAC00
        tail = index % 28
        return F.when(index.between(0, 11171), F.concat(
            letter((0x1100 + F.floor(index / 588)).cast("long")),
            letter((0x1161 + F.floor((index % 588) / 28)).cast("long")),
            F.when(tail > 0, letter((0x11A7 + tail).cast("long"))).otherwise(""))).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), syllable), "")


def normalise_title(title: Column) -> Column:
    """Letters and digits only, accents dropped, lower case, one character at a time.

    Characters outside the basic plane are dropped. ASCII titles take a short
    path; Hangul is only decomposed where a title holds any.
    """
    sources, targets = _letter_map()
    plain = F.lower(F.regexp_replace(title, r"[^A-Za-z0-9]", ""))
    folded = F.regexp_replace(F.translate(title, sources, targets),
                              r"[^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}]", "")
    folded = F.lower(folded)
    return (F.when(title.rlike(r"^\p{ASCII}*\z"), plain)
            .when(title.rlike(r"[\x{AC00}-\x{D7A3}]"), _split_hangul(folded))
            .otherwise(folded))


def game_key(system_key: Column, normalised: Column) -> Column:
    return F.concat_ws(":", system_key, normalised)


def sort_title(title: Column) -> Column:
    """``The X`` sorts as ``X, The``."""
    return (F.when(F.upper(F.substring(title, 1, 4)) == "THE ",
                   F.concat(F.substring(title, F.lit(5), F.length(title)), F.lit(", The")))
            .otherwise(title))


def _strip_prefix(title: Column, pattern: str) -> Column:
    rest = strip_blanks(F.regexp_replace(title, pattern, ""))
    return F.when(title.rlike(pattern) & (rest != ""), rest)


def strip_rank_prefix(title: Column) -> Column:
    """Drop a zero-padded rank such as ``001 - ``; null when there is none."""
    return _strip_prefix(title, RANK_PREFIX)


def strip_any_number_prefix(title: Column) -> Column:
    """Drop any leading 2-5 digit number; null when there is none."""
    return _strip_prefix(title, ANY_NUMBER_PREFIX)


def strip_trailing_tags(title: Column) -> Column:
    """Drop trailing ``(..)``/``[..]`` groups, but never the whole title."""
    stripped = F.regexp_replace(F.regexp_replace(title, TRAILING_TAGS, ""), rf"{_S}+\z", "")
    first_tag = F.regexp_extract(title, FIRST_TAG_TAIL, 1)
    return (F.when(stripped != "", stripped)
            .when(first_tag != "", first_tag)
            .otherwise(title))


def title_numbers(title: Column) -> Column:
    """The digit runs of a title, in order."""
    return F.regexp_extract_all(title, F.lit(r"\p{Nd}+"), F.lit(0))


def title_similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length; two empty titles are equal."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(left, right).cast("double") / longest)


def fuzzy_bucket(title: Column) -> Column:
    """First character and length band."""
    return F.when(title == "", F.lit("")).otherwise(
        F.concat_ws("-", F.substring(title, 1, 1), F.floor(F.length(title) / 4).cast("string")))


def sanitise_folder(name: Column) -> Column:
    """Characters no file system takes become ``_``."""
    forbidden = FOLDER_FORBIDDEN + "".join(map(chr, range(1, 32)))
    cleaned = F.translate(name, forbidden, "_" * len(forbidden))
    return F.regexp_replace(cleaned, r"\x00", "_")


def artwork_key(catalog_name: Column, title: Column, region: Column) -> Column:
    """Join key to an artwork table: catalog name, else title with its first region."""
    first_region = strip_blanks(F.split(region, ",", -1)[0])
    resolved = (F.when(~is_blank(catalog_name), catalog_name)
                .when(is_blank(title), F.lit(None).cast("string"))
                .when(is_blank(region) | is_blank(first_region), title)
                .otherwise(F.concat(title, F.lit(" ("), first_region, F.lit(")"))))
    return F.translate(resolved, ARTWORK_FORBIDDEN, "_" * len(ARTWORK_FORBIDDEN))
