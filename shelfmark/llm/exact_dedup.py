"""Exact deduplication with a heavy-hitter split; DataFrame functions only.

A Misra-Gries family summary (Spark's ``approx_top_k``) names the digests that
may be frequent. Those digests are counted exactly with map-side combine: at most
``heavy`` winner rows, which are broadcast, so that rows of hot groups never
meet in one task. All other digests go through one ordinary shuffle of
(digest, doc_id); texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, settled, texts
from shelfmark.plans.skew import broadcast_if_small

#: Digests taken as heavy: the row bound of the broadcast.
HEAVY = 1000
#: Counters of a summary. A digest with more than rows / TRACKED copies is always found.
TRACKED = 10_000
#: First-level summaries, merged in a second step.
SUMMARIES = 64


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row): SHA-256 of the text with runs of white space made one space."""
    plain = F.regexp_replace("text", SPACES, " ")
    return texts(docs).select("doc_id", F.unhex(F.sha2(plain, 256)).alias("digest"),
                              F.monotonically_increasing_id().alias("row"))


def frequent(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """(item): 64-bit hashes of the digests that the summaries hold to be the most frequent."""
    first = (rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SUMMARIES)))
             .agg(F.expr(f"approx_top_k_accumulate(xxhash64(digest), {tracked})").alias("state")))
    # Grouped by a constant, so that no rows give no summary.
    merged = first.withColumn("one", F.lit(0)).groupBy("one").agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(state, {heavy})")).alias("e")).select("e.item")


def mark(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays; a null doc_id comes
    last; of rows that repeat a doc_id and a text exactly one stays. A null text
    equals an empty one. No rows give no rows; further columns are ignored.
    """
    rows = settled(digests(docs))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    named = frequent(rows, heavy, tracked).limit(heavy)
    winners = settled(rows.join(F.broadcast(named), F.xxhash64("digest") == F.col("item"), "left_semi")
                      .groupBy("digest").agg(F.min(first).alias("best"), F.count("*").alias("n")))
    split = rows.join(F.broadcast(winners), "digest", "left")
    alike = Window.partitionBy("digest")
    light = (split.filter("n IS NULL").select("doc_id", "digest", "row")
             .withColumn("best", F.min(first).over(alike)).withColumn("n", F.count("*").over(alike)))
    columns = ["doc_id", "digest", "row", "best", "n"]
    return split.filter("n IS NOT NULL").select(columns).unionByName(light.select(columns)).select(
        "doc_id", F.col("best.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat an id and a text any one stays."""
    rows = docs.withColumn("__digest", F.unhex(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "), 256)))
    gone = settled(mark(docs).filter("NOT kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__text"),
                                                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")))
    named = rows["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (rows["__digest"] == F.col("__text"))
    copies, again = gone.filter("NOT again").distinct(), gone.filter("again").distinct()
    stays = rows.join(broadcast_if_small(copies), named, "left_anti")
    if not again.isEmpty():
        stays = (stays.join(broadcast_if_small(again), named, "left_anti").unionByName(
            stays.join(broadcast_if_small(again), named, "left_semi").dropDuplicates(["doc_id", "__digest"])))
    return stays.drop("__digest")


def op1_exact_dedup(docs: DataFrame) -> DataFrame:
    return mark(docs)


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
