"""Helpers that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import scratch_path, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words, and words themselves, wherever a contract says so.
SPACES = r"[\x20\x09-\x0D]+"


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string), a null text counting as empty; other columns are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def settled(rows: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Write as Parquet below the cluster's shared folder and read again."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shards_for(total: int, each: int, least: int = 8) -> int:
    return max(least, math.ceil(total / each))
