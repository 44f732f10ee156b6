from datetime import datetime, timedelta

from shelfmark.streaming import inventory

SCHEMA = "path string, size long, modified timestamp, location string, arrived timestamp"
DAY = datetime(2024, 1, 1)


def drop(spark, folder, rows):
    spark.createDataFrame([(p, s, DAY + timedelta(days=m), "/l", DAY + timedelta(hours=a)) for p, s, m, a in rows],
                          SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run_batches(spark, tmp_path, batches, runs=None, delay="0 seconds"):
    """Each batch: rows of files, and ends of runs (location, started, completed in hours, complete)."""
    source, ended, out, marks = tmp_path / "in", tmp_path / "runs", str(tmp_path / "out"), str(tmp_path / "marks")
    schema = "location string, started timestamp, completed timestamp, complete boolean"
    for n, rows in enumerate(batches):
        drop(spark, source, rows)
        stream, ends = spark.readStream.schema(SCHEMA).parquet(str(source)), None
        if runs is not None:
            spark.createDataFrame([(place, DAY + timedelta(hours=a), DAY + timedelta(hours=b), whole) for place, a, b, whole in runs[n]],
                                  schema).coalesce(1).write.mode("append").parquet(str(ended))
            ends = spark.readStream.schema(schema).parquet(str(ended))
        inventory.continuous_inventory(stream, out, marks, ends, delay, parts=4).awaitTermination()
    return spark.read.parquet(out)


def test_inventory_over_several_batches(spark, tmp_path):
    batches = [[("/a", 1, 0, 0), ("/b", 1, 0, 0)], [("/A", 2, 1, 5), ("/c", 3, 0, 6), ("/c", 4, 0, 7)], [("/b", 1, 0, 9)]]
    changes = run_batches(spark, tmp_path, batches)
    got = {r.file_key: (r.path, r.size, r.status, r.changed) for r in inventory.current_inventory(changes).collect()}
    assert got == {"/A": ("/A", 2, "Normal", DAY + timedelta(hours=5)), "/B": ("/b", 1, "Normal", DAY), "/C": ("/c", 4, "Normal", DAY + timedelta(hours=7))}
    # Only what changed is written: /b in the last batch is not.
    assert sorted((r.file_key, r.change, r.number) for r in changes.collect()) == [
        ("/A", "added", 1), ("/A", "changed", 2), ("/B", "added", 1), ("/C", "added", 1)]


def test_runs_mark_missing_files(spark, tmp_path):
    batches = [[("/a", 1, 0, 1), ("/b", 1, 0, 1), ("/c", None, 0, 1)], [("/a", 1, 0, 11)], [("/b", 1, 0, 21), ("/a", 1, 0, 22)], [("/z", 1, 0, 40)]]
    runs = [[("/l", 0, 2, True)], [("/l", 10, 12, True)], [("/l", 20, 23, False), ("/other", 20, 23, True)], [("/l", 39, 41, True)]]
    changes = run_batches(spark, tmp_path, batches, runs)
    hours = lambda stamp: (stamp - DAY).total_seconds() / 3600
    got = sorted((r.file_key, r.number, r.change, hours(r.changed)) for r in changes.collect())
    assert got == [("/A", 1, "added", 1), ("/A", 2, "missing", 41), ("/B", 1, "added", 1), ("/B", 2, "missing", 12), ("/B", 3, "returned", 21),
                   ("/B", 4, "missing", 41), ("/C", 1, "added", 1), ("/C", 2, "missing", 12), ("/Z", 1, "added", 40)]
    status = {r.file_key: (r.status, r.size) for r in inventory.current_inventory(changes).collect()}
    assert status == {"/A": ("Missing", 1), "/B": ("Missing", 1), "/C": ("Missing", None), "/Z": ("Normal", 1)}


def test_first_seen(spark, tmp_path):
    source = tmp_path / "in"
    drop(spark, source, [("/a", 1, 0, 0), ("/a", 1, 0, 1), ("/a", 2, 0, 2)])
    rows = inventory.first_seen(spark.readStream.schema(SCHEMA).parquet(str(source)), "2 days").select("path", "size")
    run = (rows.writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start())
    run.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("/a", 1), ("/a", 2)]
