"""Running totals per key where one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored


def running_totals(rows: DataFrame, key: str, order: list[str], totals: dict[str, str], number: str, label: str) -> DataFrame:
    """``rows`` with ``number`` (place within ``key``, from 1, in ``order``) and a running total for each name in ``totals``.

    ``totals`` maps a new column to the long column it adds up, the row itself included; ``order`` holds SQL
    sort expressions. Rows are dealt by ranges of (key, order), so a key with many rows lies in many
    partitions; totals run within each partition, and what the partitions before it hold of a key is added.
    Only the keys at the edges of partitions can go on in another one, so that table has at most two rows per partition.
    """
    sorting = [F.expr(name.rsplit(" ", 1)[0]).desc() if name.endswith(" DESC") else F.expr(name).asc_nulls_first() for name in order]
    placed = stored(rows.repartitionByRange(F.col(key).asc(), *sorting).withColumn("__part", F.spark_partition_id()), label)
    within = Window.partitionBy("__part", key).orderBy(*sorting).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", F.count(F.lit(1)).over(within).alias("__count"),
                          *[F.sum(column).over(within).alias(f"__{name}") for name, column in totals.items()])
    edges = (placed.groupBy("__part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
             .select(F.explode(F.array("low", "high")).alias(key)).distinct())
    parts = (placed.join(F.broadcast(edges), key, "left_semi").groupBy(key, "__part")
             .agg(F.count(F.lit(1)).alias("__count"), *[F.sum(column).alias(f"__{name}") for name, column in totals.items()]))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["__count", *[f"__{name}" for name in totals]]
    offsets = parts.select(key, "__part", *[F.sum(name).over(before).alias(f"{name}_before") for name in names])
    joined = local.join(F.broadcast(offsets), [key, "__part"], "left")
    whole = {number if name == "__count" else name[2:]: F.col(name) + F.coalesce(F.col(f"{name}_before"), F.lit(0)) for name in names}
    return joined.select(*rows.columns, *[value.alias(name) for name, value in whole.items()])
