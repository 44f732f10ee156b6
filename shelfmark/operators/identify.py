"""Which platform and format a file belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions.text import extension_of, fold_case, normalise_extension
from shelfmark.plans.skew import broadcast_if_small

# Letters outside the basic plane count as word breaks, like any other sign.
WORD_BREAKS = r"(?:[^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}])+"


def supported_only(listing: DataFrame, formats: DataFrame) -> DataFrame:
    """Rows whose extension some format claims."""
    known = broadcast_if_small(formats.select(F.col("extension").alias("known_extension")).distinct())
    return listing.join(known, normalise_extension(listing["extension"]) == F.col("known_extension"),
                        "left_semi")


def candidates_by_extension(formats: DataFrame) -> DataFrame:
    """One row per extension with its claimants in platform order, and what to look for in a path, made up once."""
    key = F.upper("system_key")
    claimant = F.struct("system_position", "format_position", "system_key", "system_name",
                        "format_name", "format_type", "priority", "is_multi_file",
                        F.concat(F.lit("/"), key, F.lit("/")).alias("folder"), F.concat(F.lit(" "), key, F.lit(" ")).alias("word"),
                        F.upper("system_name").alias("folded_name"))
    return (formats.groupBy(F.col("extension").alias("claimed_extension"))
            .agg(F.sort_array(F.collect_list(claimant)).alias("claimants")))


def _score(claimant: Column, hints: Column) -> Column:
    by_path = (F.when(F.contains(hints["folded"], claimant["folder"]), V.SCORE_PATH_SEGMENT)
               .when(F.contains(hints["words"], claimant["word"]), V.SCORE_KEY_TOKEN)
               .otherwise(0))
    by_name = F.when(F.contains(hints["folded"], claimant["folded_name"]), V.SCORE_SYSTEM_NAME).otherwise(0)
    return claimant["priority"] + by_path + by_name


def score_candidates(listing: DataFrame, formats: DataFrame) -> DataFrame:
    """Adds ``claimants`` of the extension in platform order, and ``ranked``: (order, at), their scores and places, best first.

    The platform table is joined once, as one row per extension, and scored
    inside the row. It is broadcast after a check of its rows, so the listing stays
    where it is; there is no row per claimant.
    """
    joined = listing.join(broadcast_if_small(candidates_by_extension(formats)),
                          normalise_extension(listing["extension"]) == F.col("claimed_extension"), "left")
    # Paths that no format claims are not looked at.
    folded = F.when(F.col("claimants").isNotNull(), fold_case(F.translate("path", "\\", "/")))
    words = F.concat(F.lit(" "), F.regexp_replace(folded, WORD_BREAKS, " "), F.lit(" "))
    bonus = F.when(F.size("claimants") == 1, V.SCORE_SINGLE_CANDIDATE).otherwise(0)
    # A one-element array binds the path hints once per row instead of per claimant.
    hints = F.array(F.struct(folded.alias("folded"), words.alias("words"), bonus.alias("bonus")))
    ranked = F.transform(hints, lambda h: F.transform(
        F.col("claimants"), lambda c, at: F.struct((-_score(c, h) - h["bonus"]).alias("order"), at.alias("at"))))[0]
    return joined.withColumn("ranked", F.sort_array(ranked)).drop("claimed_extension")


def best_format(scored: DataFrame) -> DataFrame:
    """Picks the best claimant; confidence says how clear the choice was."""
    best, second = F.try_element_at("ranked", F.lit(1)), F.try_element_at("ranked", F.lit(2))
    confidence = (F.when(F.col("ranked").isNull(), 0.0)
                  .when(F.size("ranked") == 1, V.CONFIDENCE_SINGLE)
                  .when(best["order"] < second["order"], V.CONFIDENCE_CLEAR)
                  .otherwise(V.CONFIDENCE_TIE))
    reason = (F.when(F.col("ranked").isNull(), "Unsupported extension")
              .when(F.col("confidence") <= 0.5, "Ambiguous extension; selected highest-priority format")
              .otherwise("Extension and path hints"))
    return (scored.withColumn("best", F.try_element_at("claimants", best["at"] + 1)).withColumn("confidence", confidence).withColumn("reason", reason)
            .withColumns({name: F.col(f"best.{name}") for name in
                          ["system_key", "system_name", "format_name", "format_type", "is_multi_file"]})
            .withColumn("score", -best["order"])
            .drop("ranked", "best", "claimants"))


def identify_format(listing: DataFrame, formats: DataFrame) -> DataFrame:
    """Listing rows with platform, format, confidence and reason."""
    return best_format(score_candidates(listing, formats))


IDENTITY = ["system_key", "system_name", "format_name", "format_type", "is_multi_file", "confidence", "reason"]


def best_archive_entry(entries: DataFrame, formats: DataFrame) -> DataFrame:
    """Per archive, its most confidently identified entry; entry order breaks ties.

    ``entries``: archive_path, position, entry_name (full name inside the archive).
    """
    rows = entries.select(
        "archive_path", "position",
        F.concat_ws("/", "archive_path", "entry_name").alias("path"),
        extension_of(F.col("entry_name")).alias("extension"))
    found = identify_format(supported_only(rows, formats), formats)
    choice = F.struct((-F.col("confidence")).alias("order"), "position", *IDENTITY)
    return (found.groupBy("archive_path").agg(F.min(choice).alias("best"))
            .select("archive_path", *[F.col(f"best.{name}").alias(name) for name in IDENTITY]))


def identify_with_archives(listing: DataFrame, entries: DataFrame, formats: DataFrame) -> DataFrame:
    """Archives take the identity of their best entry, else their own extension's."""
    own = identify_format(listing, formats)
    inner = best_archive_entry(entries, formats).select(
        F.col("archive_path").alias("path"),
        F.struct(*IDENTITY).alias("inner"))
    joined = own.join(inner, "path", "left")
    is_archive = F.lower("extension").isin(V.ARCHIVE_EXTENSIONS) & F.col("inner").isNotNull()
    raised = F.least(F.lit(V.ARCHIVE_CONFIDENCE_CAP), F.col("inner.confidence") + V.ARCHIVE_CONFIDENCE_BONUS)
    reason = F.concat(F.upper(F.substring(F.col("extension"), F.lit(2), F.length("extension"))),
                      F.lit(" archive contains a recognized "), F.col("inner.system_name"), F.lit(" file"))
    updates = {name: F.when(is_archive, F.col(f"inner.{name}")).otherwise(F.col(name)) for name in IDENTITY}
    updates["confidence"] = F.when(is_archive, raised).otherwise(F.col("confidence"))
    updates["reason"] = F.when(is_archive, reason).otherwise(F.col("reason"))
    return joined.withColumns(updates).drop("inner")


def resolve_format(files: DataFrame, formats: DataFrame) -> DataFrame:
    """Attach the format position for (system, extension, format name).

    Every file stays. Where the format is not known, ``format_position`` is null and ``format_problem`` says so.
    """
    wanted = formats.select("system_key", "extension", "format_name", "format_position")
    found = files.join(wanted, ["system_key", "extension", "format_name"], "left")
    return found.withColumn("format_problem", F.when(F.col("format_position").isNull(), "no such format of the system"))
