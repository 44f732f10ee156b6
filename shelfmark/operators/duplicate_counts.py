"""Duplicate status that follows the library from run to run, by counts per content that each run changes a little.

A file is a duplicate while at least two present files have its content. A run says which files it gained and lost; only
the counts of their contents are looked at, and only files of contents that began or ceased to be shared change their status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.skew import lookup_join
from shelfmark.sources.state import BucketedState, create_state


def count_copies(present: DataFrame) -> DataFrame:
    """(sha256, copies) of all present files: what the counts begin with. ``present``: file_key, sha256."""
    return present.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("copies"))


def start_counts(present: DataFrame, path: str, buckets: int = 256, counts: DataFrame | None = None) -> BucketedState:
    """The state of a first run. ``counts``: what ``count_copies`` gives for ``present``, where it is known already."""
    return create_state(count_copies(present) if counts is None else counts, path, "sha256", buckets)


def count_steps(gained: DataFrame, lost: DataFrame) -> DataFrame:
    """(sha256, step): files more or less of each content that a run touches. ``gained`` and ``lost``: file_key, sha256."""
    return (gained.select("sha256", F.lit(1).cast("long").alias("step"))
            .unionByName(lost.select("sha256", F.lit(-1).cast("long").alias("step"))).filter("sha256 IS NOT NULL")
            .groupBy("sha256").agg(F.sum("step").alias("step")))


def count_changes(counts: DataFrame, steps: DataFrame) -> DataFrame:
    """(sha256, before, copies) of the contents that a run touches. ``steps``: from ``count_steps``."""
    joined = steps.join(counts, "sha256", "left").withColumn("before", F.coalesce("copies", F.lit(0).cast("long")))
    return joined.select("sha256", "before", (F.col("before") + F.col("step")).alias("copies"))


def status_changes(changes: DataFrame, present: DataFrame, gained: DataFrame | str) -> DataFrame:
    """(file_key, status) of the files whose status follows from a run.

    ``changes``: from ``count_changes``; ``present``: file_key, sha256 of all files there after the run. A content that begins to be
    shared makes all its files Duplicate, one that ceases makes its last file Normal; otherwise only gained files are settled.
    ``gained`` may name a boolean column of ``present`` that is true for the gained files; all files then meet the changes once.
    """
    turned = changes.withColumn("status", F.when((F.col("before") < 2) & (F.col("copies") >= 2), "Duplicate")
                                .when((F.col("before") >= 2) & (F.col("copies") < 2), "Normal"))
    settled = F.when(F.col("copies") >= 2, "Duplicate").otherwise("Normal")
    if isinstance(gained, str):
        met = lookup_join(present.select("file_key", "sha256", gained), turned.select("sha256", "status", "copies"), ["sha256"], "copies", "inner",
                          salt_on=["file_key"])
        return met.filter(F.col("status").isNotNull() | F.col(gained)).select("file_key", F.coalesce("status", settled).alias("status"))
    turning = turned.filter("status IS NOT NULL").select("sha256", "status", "copies")
    old = lookup_join(present.select("file_key", "sha256"), turning, ["sha256"], "copies", "inner", salt_on=["file_key"]).select("file_key", "status")
    steady = turned.filter("status IS NULL").select("sha256", "copies")
    new = (lookup_join(gained.select("file_key", "sha256"), steady, ["sha256"], "copies", "inner", salt_on=["file_key"])
           .select("file_key", settled.alias("status")))
    return old.unionByName(new)


def follow_run(state: BucketedState, version: int, gained: DataFrame, lost: DataFrame, present: DataFrame, flag: str | None = None) -> DataFrame:
    """Write the counts after a run as version + 1 and return the files' new statuses.

    Reads and rewrites the buckets of the touched contents only. ``flag`` may name a boolean column of ``present`` that is true for the
    gained files.
    """
    # The files are read once for what the run adds up to; all else about the counts follows from that.
    steps = count_steps(gained, lost).checkpoint()
    touched = {row.bucket for row in steps.select(state.bucket_of(F.col("sha256")).alias("bucket")).distinct().collect()}
    changes = count_changes(state.read(version, touched), steps).checkpoint()
    state.merge(version, changes.filter("copies > 0").select("sha256", "copies"), changes.filter("copies <= 0").select("sha256"))
    return status_changes(changes, present, flag or gained)
