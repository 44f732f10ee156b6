"""Scans over a global order: what earlier rows say about later ones, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import shared_folder


def in_ranges(rows: DataFrame, order: list[str], part: str = "__part") -> DataFrame:
    """``rows`` dealt by ranges of ``order``, with the number of their range; stored, so that the ranges stay as they are."""
    shared_folder(rows.sparkSession)
    return rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).checkpoint()


def running_maximum(rows: DataFrame, order: list[str], value: str, into: str) -> DataFrame:
    """``into``: the greatest ``value`` of this row and all rows before it in ``order``, null while there is none.

    Each range is scanned by itself; one number per range, the greatest of all earlier ranges, is carried over its edge.
    """
    placed = in_ranges(rows, order)
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per range, however many rows there are.
    edges = placed.groupBy("__part").agg(F.max(value).alias("__most"))
    before = edges.select("__part", F.max("__most").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    return (placed.withColumn("__local", F.max(value).over(within)).join(F.broadcast(before), "__part", "left")
            .withColumn(into, F.greatest("__local", "__carried")).drop("__part", "__local", "__carried"))
