"""Listings that arrive over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfmark.functions.text import fold_case

STATE_SCHEMA = ("file_key string, path string, size long, modified timestamp, location string, "
                "status string, last_seen timestamp")


def inventory_step(previous: DataFrame, arrived: DataFrame) -> DataFrame:
    """One micro-batch applied to the inventory.

    ``arrived``: path, size, modified, location, arrived. A file may be listed
    several times in one batch; the last arrival counts. New and changed files
    become Normal; an unchanged file is touched and comes back from Missing.
    Files not in the batch stay as they are.
    """
    latest = (arrived.groupBy(fold_case(F.col("path")).alias("file_key"))
              .agg(F.max_by(F.struct("path", "size", "modified", "location"),
                            F.struct("arrived", "modified", "size", "path")).alias("new"),
                   F.max("arrived").alias("arrived")))
    old = previous.select("file_key", F.struct("path", "size", "modified", "location", "status", "last_seen").alias("old"))
    rows = old.join(latest, "file_key", "full_outer")
    same = F.col("old.size").eqNullSafe(F.col("new.size")) & F.col("old.modified").eqNullSafe(F.col("new.modified"))
    listed = F.col("new").isNotNull()
    fresh = listed & (F.col("old").isNull() | ~same)
    status = F.when(fresh | (listed & (F.col("old.status") == "Missing")), "Normal").otherwise(F.col("old.status"))
    return rows.select(
        "file_key", *[F.when(fresh, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
                      for name in ("path", "size", "modified", "location")],
        status.alias("status"), F.coalesce("arrived", "old.last_seen").alias("last_seen"))


#: Parts of a location's state; a location of any size is spread over so many keys.
PARTS = 64
CHANGES = ("file_key string, location string, path string, size long, modified long, status string, change string, "
           "changed long, number long")
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _KeptFiles(StatefulProcessor):
    """The files of one part of a location, and its runs that have not been settled yet.

    Times are microseconds. A file that is listed becomes or stays Normal. The end of a complete
    run sets a timer; once no listing row from before it can arrive any more, files last seen before the run began are Missing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file_key string", "path string, size long, modified long, last_seen long, missing boolean, number long")
        self.runs = handle.getMapState("runs", "completed long", "started long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        ended = arrived[arrived["started"].notna()]
        for completed, started in zip(ended["at"], ended["started"]):
            before = self.runs.getValue((int(completed),))
            self.runs.updateValue((int(completed),), (max(int(started), before[0] if before else 0),))
            self.handle.registerTimer(int(completed) // 1000)
        pending = sorted((completed, started) for (completed,), (started,) in self.runs.iterator())
        listed = arrived[arrived["started"].isna()].sort_values(["at", "modified", "size", "path"], na_position="first")
        # What a file's last row between two ends of runs says is all that counts.
        listed = listed.assign(between=np.searchsorted(np.array([completed for completed, _ in pending], "int64"), listed["at"].to_numpy("int64")))
        changes, name, kept = [], None, None
        for row in listed.groupby(["file_key", "between"], sort=False).tail(1).sort_values(["file_key", "between"]).itertuples():
            if row.file_key != name:
                if name is not None:
                    self.files.updateValue((name,), kept)
                name, kept = row.file_key, self.files.getValue((row.file_key,))
            kept = self._listed(key[0], kept, row, pending, changes)
        if name is not None:
            self.files.updateValue((name,), kept)
        yield _changes(changes)

    def _listed(self, location, old, row, pending, changes: list) -> tuple:
        """The new state of a listed file; adds what changed, the end of a run that did not list the file included."""
        seen, number, missing = int(row.at), 0, False
        new = (row.path, _whole(row.size), _whole(row.modified))

        def change(kind: str, at: int, values: tuple) -> None:
            nonlocal number
            number += 1
            changes.append((row.file_key, location, *values, "Missing" if kind == "missing" else "Normal", kind, at, number))

        if old is None:
            change("added", seen, new)
            return *new, seen, False, number
        path, size, modified, before, missing, number = old
        held = (path, _whole(size), _whole(modified))
        if not missing:
            ended = next((completed for completed, started in pending if started > before and completed < seen), None)
            if ended is not None:
                missing = True
                change("missing", ended, held)
        if held[1:] != new[1:]:
            change("changed", seen, new)
            held = new
        elif missing:
            change("returned", seen, held)
        # An unchanged file keeps the path it was first listed by.
        return *held, max(seen, before), False, number

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = [(completed, started) for (completed,), (started,) in self.runs.iterator() if completed // 1000 <= expiredTimerInfo.getExpiryTimeInMs()]
        for completed, _ in ended:
            self.runs.removeKey((completed,))
        if not ended:
            return
        started = max(started for _, started in ended)
        gone = [(name, kept) for (name,), kept in self.files.iterator() if not kept[4] and kept[3] < started]
        for at in range(0, len(gone), 10_000):
            changes = []
            for name, (path, size, modified, seen, _, number) in gone[at:at + 10_000]:
                self.files.updateValue((name,), (path, size, modified, seen, True, number + 1))
                changes.append((name, key[0], path, _whole(size), _whole(modified), "Missing", "missing", max(c for c, _ in ended), number + 1))
            yield _changes(changes)

    def close(self) -> None:
        pass


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _changes(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[part.split()[0] for part in CHANGES.split(", ")])
    return frame.astype({name: "Int64" for name in ("size", "modified", "changed", "number")})


def inventory_changes(listings: DataFrame, runs: DataFrame | None = None, delay: str = "1 hour", parts: int = PARTS) -> DataFrame:
    """The stream of changes of an inventory: file_key, location, path, size, modified, status, change, changed, number.

    ``listings``: a stream of path, size, modified, location, arrived. ``runs``: a stream of location, started, completed,
    complete; an incomplete run marks nothing. change is added, changed, returned or missing; ``number`` counts the changes of
    a file. A file listed several times in one batch counts by its last arrival. Each batch reads and writes the state of its own
    files only; the end of a run passes over the files of its location, part by part. Rows that come later than ``delay`` after
    newer ones are dropped. Rows with a null path or location are left out.
    """
    columns = ["location", "part", "file_key", "path", "size", "modified", "started", "at", "arrived"]
    key = fold_case(F.col("path"))
    none = {name: F.lit(None).cast(kind) for name, kind in (("file_key", "string"), ("path", "string"), ("size", "long"), ("modified", "long"),
                                                            ("started", "long"))}

    def micros(name: str):
        return F.unix_micros(F.col(name).cast("timestamp"))

    rows = (listings.filter("path IS NOT NULL AND location IS NOT NULL")
            .select("location", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), key.alias("file_key"), "path",
                    F.col("size").cast("long").alias("size"), micros("modified").alias("modified"), none["started"].alias("started"),
                    micros("arrived").alias("at"), F.col("arrived").cast("timestamp").alias("arrived")))
    if runs is not None:
        ends = (runs.filter("complete AND location IS NOT NULL")
                .select("location", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                        *[none[name].alias(name) for name in ("file_key", "path", "size", "modified")], micros("started").alias("started"),
                        micros("completed").alias("at"), F.col("completed").cast("timestamp").alias("arrived")))
        rows = rows.select(columns).unionByName(ends.select(columns))
    return (rows.withWatermark("arrived", delay).groupBy("location", "part")
            .transformWithStateInPandas(_KeptFiles(), CHANGES, "Append", "EventTime")
            .withColumn("modified", F.timestamp_micros("modified")).withColumn("changed", F.timestamp_micros("changed")))


def continuous_inventory(listings: DataFrame, changes: str, checkpoint: str, runs: DataFrame | None = None,
                         delay: str = "1 hour", parts: int = PARTS) -> StreamingQuery:
    """Append the changes of an inventory to the folder ``changes`` until the sources are drained.

    State lives in RocksDB below ``checkpoint``; a batch that is run again after a failure gives the same changes once.
    """
    spark, name = listings.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKSDB)
    try:
        return (inventory_changes(listings, runs, delay, parts).writeStream.format("parquet").option("path", changes)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(name, before)


def current_inventory(changes: DataFrame) -> DataFrame:
    """The inventory that follows from its changes: the last one of each file."""
    kept = ["location", "path", "size", "modified", "status", "changed"]
    return changes.groupBy("file_key").agg(F.max_by(F.struct(*kept), "number").alias("last")).select("file_key", "last.*")


def first_seen(listings: DataFrame, delay: str) -> DataFrame:
    """Drop listing rows already seen unchanged within ``delay`` of their arrival."""
    return (listings.withWatermark("arrived", delay)
            .dropDuplicatesWithinWatermark(["path", "size", "modified"]))
