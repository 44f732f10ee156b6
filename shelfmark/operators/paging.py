"""Pages at any depth of a sorted view, each read from one range of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfmark.operators.views import filter_system, game_summary, search_games, view_games
from shelfmark.session import scratch_path


@dataclass(frozen=True)
class PageIndex:
    """Games of one view in ranges of their order: where the ranges are stored, and how many rows stand before each."""
    rows: DataFrame
    #: (range, rows before it), in order; as many entries as ranges, not rows.
    before: tuple[tuple[int, int], ...]
    total: int


def page_index(games: DataFrame, files: DataFrame, *, view: str = "All", system_key: str | None = None,
               term: str | None = None, path: str | None = None) -> PageIndex:
    """Lay out the games of a view by ranges of (sort_title, game_key), once; its pages are then cut from single ranges."""
    rows = view_games(search_games(filter_system(games, system_key), files, term), files, view)
    spark = games.sparkSession
    path = path or scratch_path(spark, "pages")
    # Stored by range, so that a page opens the files of its range only; within a file rows lie in order, with their extremes on record.
    (rows.repartitionByRange("sort_title", "game_key").withColumn("range", F.spark_partition_id())
     .sortWithinPartitions("range", "sort_title", "game_key").write.partitionBy("range").parquet(path))
    stored = spark.read.schema(StructType([*rows.schema.fields, StructField("range", IntegerType())])).parquet(path)
    counts = sorted((row["range"], row["n"]) for row in stored.groupBy("range").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for number, n in counts:
        before.append((number, total))
        total += n
    return PageIndex(stored, tuple(before), total)


def index_page(index: PageIndex, files: DataFrame, systems: DataFrame, skip: int, take: int) -> DataFrame:
    """The rows of ``page_games`` for the indexed view: only the ranges that hold the page are read and sorted."""
    if skip < 0:
        raise ValueError("skip must not be negative")
    if take <= 0:
        raise ValueError("take must be positive")
    ends = [start for _, start in index.before[1:]] + [index.total]
    held = [(number, start) for (number, start), end in zip(index.before, ends) if start < skip + take and end > skip]
    order = ["sort_title", "game_key"]
    rows = index.rows.filter(F.col("range").isin([number for number, _ in held])).drop("range")
    cut = rows.orderBy(*order).offset(skip - held[0][1] if held else 0).limit(take)
    # A window over at most ``take`` rows.
    numbered = (cut.withColumn("position", F.row_number().over(Window.orderBy(*order)))
                .withColumn("has_more", F.lit(index.total > skip + take)))
    page_keys = F.broadcast(numbered.select("game_key"))
    summary = game_summary(numbered.drop("position", "has_more"), files.join(page_keys, "game_key", "left_semi"), systems)
    flags = F.broadcast(numbered.select("game_key", "position", "has_more"))
    return summary.join(flags, "game_key").orderBy("position")
