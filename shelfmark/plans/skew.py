"""Joins and groups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys treated as hot. This is also the row bound of the broadcast below.
HOT_KEYS = 1000


def broadcast_if_small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Mark a control table for broadcast only once its row count is proven small.

    A larger one is left to a shuffled join, which AQE splits where it is skewed.
    """
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str,
                how: str = "left", salt_on: list[str] | None = None,
                hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join ``rows`` to a one-row-per-key ``lookup`` without a hot partition.

    ``weight`` names the lookup column that says how many rows carry the key.
    The heaviest ``hot_keys`` lookup rows are broadcast, so their rows need no
    co-location: they are spread by a salt that matches nothing in the shuffled
    join, as are rows with a null key. All other keys are light by construction.
    Each row keeps exactly the match a plain join would give it.
    """
    values = [name for name in lookup.columns if name not in keys]
    packed = lookup.select(*keys, F.struct(*values).alias("__value"), F.col(weight).alias("__weight"))
    hot = (packed.orderBy(F.desc("__weight")).limit(hot_keys)
           .select(*keys, F.col("__value").alias("__hot")))
    cold = packed.select(*keys, F.lit(0).alias("__salt"), F.col("__value").alias("__cold"))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    spread = 1 + F.pmod(F.xxhash64(*(salt_on or rows.columns)), F.lit(1_000_003)).cast("int")
    joined = (rows.join(F.broadcast(hot), keys, "left")
              .withColumn("__salt", F.when(F.col("__hot").isNotNull() | no_key, spread).otherwise(0))
              .join(cold, [*keys, "__salt"], "left")
              .withColumn("__value", F.coalesce("__hot", "__cold")))
    if how == "inner":
        joined = joined.filter(F.col("__value").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"__value.{name}").alias(name) for name in values])
