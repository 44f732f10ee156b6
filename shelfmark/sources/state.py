"""Tables that jobs change a little at a time: kept in buckets of their key, of which a change rewrites only those it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Shares of all buckets together that rows are dealt by, so that a table in few buckets is still written by many tasks.
SHARES = 1024
#: Bits that say which keys a change may name, told to the tasks in words of 64 (16 bytes each, 8 MB at most); files of a bucket from which on it is dealt anew.
BITS, FILES = 1 << 25, 64


@dataclass(frozen=True)
class BucketedState:
    """A table below ``path``, unique on ``key``, in ``buckets`` parts.

    Version n lists, for each bucket, the version that wrote it last; that list is written after the
    data, so a job that fails leaves version n as it was and can simply run again. Old versions stay readable.
    """
    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: StructType

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _listed(self, version: int) -> dict[int, int]:
        """Bucket → version that holds it; as many entries as buckets with rows."""
        return {row.bucket: row.version for row in self.spark.read.parquet(f"{self.path}/lists/{version}").collect()}

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their bucket, dealt by bucket and share of it; all rows of a key are in one share."""
        share = F.pmod(F.xxhash64(F.lit("share"), F.col(self.key)), F.lit(max(1, SHARES // self.buckets))).cast("int")
        return rows.withColumn("bucket", self.bucket_of(F.col(self.key))).withColumn("__share", share).repartition("bucket", "__share")

    def _parted(self, old: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``old`` rows whose key is surely not in ``named``, and those whose key may be."""
        at = F.pmod(F.xxhash64(F.lit("bit"), F.col(self.key)), F.lit(BITS))
        place = (at % 64).cast("int")
        words = (named.filter(F.col(self.key).isNotNull()).select(F.shiftright(at, 6).alias("__word"), place.alias("__place"))
                 .groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __place)")).alias("__bits")))
        marked = (old.withColumn("__word", F.shiftright(at, 6)).join(F.broadcast(words), "__word", "left")
                  .withColumn("__may", F.coalesce(F.getbit("__bits", place) == 1, F.lit(False))))
        return marked.filter(~F.col("__may")).select(old.columns), marked.filter("__may").select(old.columns)

    def _write(self, rows: DataFrame, version: int, kept: dict[int, int]) -> None:
        data = f"{self.path}/data/{version}"
        rows.select(*self.schema.fieldNames(), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        schema = StructType([StructField("bucket", IntegerType())])
        written = self.spark.read.schema(StructType([*self.schema.fields, *schema.fields])).parquet(data).select("bucket").distinct().collect()
        listed = kept | {row.bucket: version for row in written}
        (self.spark.createDataFrame(sorted(listed.items()), "bucket int, version int").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/lists/{version}"))

    def read(self, version: int, buckets: set[int] | None = None) -> DataFrame:
        """The table as of ``version``, or some of its buckets: only their files are opened."""
        held = [(bucket, wrote) for bucket, wrote in sorted(self._listed(version).items()) if buckets is None or bucket in buckets]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{wrote}/bucket={bucket}" for bucket, wrote in held])

    def merge(self, version: int, changed: DataFrame | None = None, removed: DataFrame | None = None) -> set[int]:
        """Write version + 1: ``changed`` rows replace or join those of their key, ``removed`` keys go. Returns the buckets it rewrote.

        A key in both is replaced. ``changed`` is one row per key.

        Old rows that no named key can be, by one bit of its hash, are written on from where they are read. The others are dealt
        together with changed rows and removed keys; each share finds by itself which of them go.
        """
        keys = [rows.select(self.key) for rows in (changed, removed) if rows is not None]
        named = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
        # At most as many rows as there are buckets.
        times = {row.bucket: row["count"] for row in named.groupBy(self.bucket_of(F.col(self.key)).alias("bucket")).count().collect()}
        touched = set(times)
        listed = self._listed(version)
        names, old = self.schema.fieldNames(), self.read(version, touched)
        # Where most rows may be named, or rows lie in very many files, all of them are dealt anew.
        few = len(old.inputFiles()) <= FILES * len(touched) and 4 * sum(times.values()) < old.count()
        clear, open_to = self._parted(old, named) if few else (None, old)
        rows = open_to.select(*names, F.lit(0).alias("__kind"))
        if changed is not None:
            rows = rows.unionByName(changed.select(*names, F.lit(1).alias("__kind")))
        if removed is not None:
            blanks = [F.lit(None).cast(field.dataType).alias(field.name) for field in self.schema.fields if field.name != self.key]
            rows = rows.unionByName(removed.select(self.key).distinct().select(self.key, *blanks, F.lit(2).alias("__kind")))
        # A null key names no row, so rows without a key stay.
        most = F.max("__kind").over(Window.partitionBy("bucket", "__share", self.key))
        stays = (F.col("__kind") == 1) | (F.col("__kind") == 0) & (F.col(self.key).isNull() | (F.col("__most") == 0))
        left = self._dealt(rows).withColumn("__most", most).filter(stays).select(*names, "bucket")
        if clear is not None:
            left = left.unionByName(clear.select(*names, self.bucket_of(F.col(self.key)).alias("bucket")))
        self._write(left, version + 1, {bucket: wrote for bucket, wrote in listed.items() if bucket not in touched})
        return touched


def create_state(rows: DataFrame, path: str, key: str, buckets: int = 256) -> BucketedState:
    """Version 0 of a table; ``rows`` are one per key, which is not null."""
    state = BucketedState(rows.sparkSession, path.rstrip("/"), key, buckets, StructType([StructField(f.name, f.dataType) for f in rows.schema.fields]))
    state._write(state._dealt(rows), 0, {})
    return state
