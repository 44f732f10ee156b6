"""Listings that arrive as a stream: events as listing rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.session import scratch_path
from shelfmark.streaming import inventory
from shelfmark.workload.base import Tables, query


def _arrivals(t: Tables):
    """Each event lists one file of its user; its value is the size then."""
    events = t.events
    # A pattern, because a stream takes a plain path for a folder only.
    rows = t.spark.readStream.schema(events.schema).parquet(f"{t.folder}/events.parque[t]")
    return rows.select(F.concat_ws("/", F.lit("/u"), F.col("user_id").cast("string"), "event_type").alias("path"),
                       F.floor("value").cast("long").alias("size"), F.col("ts").cast("date").cast("timestamp").alias("modified"),
                       F.lit("/u").alias("location"), F.col("ts").cast("timestamp").alias("arrived"))


@query("ST1_continuous_inventory", """SELECT path, size, modified, status FROM (
    SELECT '/u/' || CAST(user_id AS STRING) || '/' || event_type AS path, CAST(floor(value) AS BIGINT) AS size,
      CAST(CAST(ts AS DATE) AS TIMESTAMP) AS modified, 'Normal' AS status,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, floor(value) DESC) AS n FROM events) a WHERE n = 1""")
def st1(t: Tables):
    changes, marks = scratch_path(t.spark, "inventory"), scratch_path(t.spark, "marks")
    inventory.continuous_inventory(_arrivals(t), changes, marks).awaitTermination()
    return inventory.current_inventory(t.spark.read.parquet(changes)).select("path", "size", "modified", "status")


# Events as listings of five locations, six days at a time; each such spell is a run of every location, but some end incomplete.
SPELL_DAYS, PLACES = 6, 5
_SPELL = f"CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / {SPELL_DAYS}) AS BIGINT)"


@query("ST1_inventory_runs", f"""WITH listed AS (
    SELECT '/u' || CAST(user_id % {PLACES} AS STRING) AS location, CAST(user_id AS STRING) || '/' || event_type AS name, CAST(floor(value) AS BIGINT) AS size,
      ts, {_SPELL} AS spell, user_id % {PLACES} AS place FROM events),
    runs AS (SELECT place, spell, DATE '2024-01-01' + CAST(spell * {SPELL_DAYS} AS INTEGER) AS started
      FROM (SELECT DISTINCT place, spell FROM listed) a WHERE (place + spell) % 3 <> 0),
    last AS (SELECT location, name, place, arg_max(size, (ts, size)) AS size, max(ts) AS seen, max(spell) AS spell FROM listed GROUP BY ALL),
    gaps AS (SELECT location, name, place, spell, lead(spell) OVER (PARTITION BY location, name ORDER BY spell) AS later
      FROM (SELECT DISTINCT location, name, place, spell FROM listed) a)
    SELECT l.location, l.location || '/' || l.name AS path, l.size,
      CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.place = l.place AND r.spell > l.spell) THEN 'Missing' ELSE 'Normal' END AS status,
      (SELECT count(*) FROM gaps g WHERE g.location = l.location AND g.name = l.name
        AND EXISTS (SELECT 1 FROM runs r WHERE r.place = g.place AND r.spell > g.spell AND (g.later IS NULL OR r.spell < g.later))) AS times_missing
    FROM last l""")
def st1_runs(t: Tables):
    """One batch per spell: its listings, then the end of its run of each location."""
    events, marks, changes = scratch_path(t.spark, "spells"), scratch_path(t.spark, "marks"), scratch_path(t.spark, "inventory")
    spell = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / SPELL_DAYS)
    place = F.concat(F.lit("/u"), (F.col("user_id") % PLACES).cast("string"))
    listed = t.events.select(
        spell.cast("int").alias("spell"), place.alias("location"), F.concat_ws("/", place, F.col("user_id").cast("string"), "event_type").alias("path"),
        F.floor("value").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"), F.col("ts").cast("timestamp").alias("arrived"),
        (F.col("user_id") % PLACES).alias("place"))
    begin = F.timestamp_add("DAY", F.col("spell") * SPELL_DAYS, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    runs = (listed.select("location", "place", "spell").distinct()
            .select("spell", "location", begin.alias("started"), F.timestamp_add("MICROSECOND", F.lit(-1), F.timestamp_add("DAY", F.lit(SPELL_DAYS), begin)).alias("completed"),
                    ((F.col("place") + F.col("spell")) % 3 != 0).alias("complete")))
    listings, ends = listed.drop("place"), runs
    spells = sorted(row.spell for row in listed.select("spell").distinct().collect())
    for n in spells:  # at most a handful: a spell is a file of each stream, in order of time
        listings.filter(F.col("spell") == n).drop("spell").coalesce(1).write.mode("append").parquet(f"{events}/listed")
        ends.filter(F.col("spell") == n).drop("spell").coalesce(1).write.mode("append").parquet(f"{events}/ended")

    def stream(name: str, schema):
        return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{events}/{name}")

    inventory.continuous_inventory(stream("listed", listings.drop("spell").schema), changes, marks, stream("ended", ends.drop("spell").schema),
                                   delay="0 seconds", parts=16).awaitTermination()
    found = t.spark.read.parquet(changes)
    times = found.groupBy("file_key").agg(F.count_if(F.col("change") == "missing").alias("times_missing"))
    return inventory.current_inventory(found).join(times, "file_key").select("location", "path", "size", "status", "times_missing")


@query("ST2_first_seen_dedup", """SELECT DISTINCT '/u/' || CAST(user_id AS STRING) || '/' || event_type AS path,
    CAST(floor(value) AS BIGINT) AS size, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS modified FROM events""")
def st2(t: Tables):
    out, marks = scratch_path(t.spark, "first-seen"), scratch_path(t.spark, "marks")
    rows = inventory.first_seen(_arrivals(t), "60 days").select("path", "size", "modified")
    run = (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return t.spark.read.parquet(out)
