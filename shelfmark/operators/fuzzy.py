"""Near-equal titles without pairing whole buckets, also where very many titles share a piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions.text import fuzzy_bucket, title_numbers, title_similarity
from shelfmark.plans.skew import broadcast_if_small, lookup_join
from shelfmark.session import shared_folder

#: Titles with one piece from which on they have to agree in a second piece as well.
HOT_TITLES = 200

_GROUP = ["system_key", "bucket", "numbers", "segment", "indexed_len"]


def _segment_bounds(length, parts, index):
    """Start (0-based) and length of segment ``index`` when a text is cut evenly."""
    start = F.floor(length * index / parts)
    return start, F.floor(length * (index + 1) / parts) - start


def _piece(text: Column, start: Column, size: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), size.cast("int"))


def _without(text: Column, start: Column, size: Column) -> Column:
    """What is left of a text without one piece."""
    return F.concat(_piece(text, F.lit(0), start), F.substring(text, (start + size + 1).cast("int"), F.length(text)))


def _informative_cuts(members: DataFrame, keys: list[str]) -> DataFrame:
    """For each key, where to cut the rests of its titles (all of one length) into ``edits`` + 1 pieces that tell as much as possible.

    A place tells little where most titles have the same character. Cuts are set so that each piece has an equal
    share of the entropy: what all titles share falls into one piece, not into several.
    """
    counts = (members.withColumn("place", F.explode(F.sequence(F.lit(1), F.length("rest"))))
              .groupBy(*keys, "edits", "place", F.expr("substring(rest, place, 1)").alias("sign")).agg(F.count("*").alias("n")))
    # Entropy of a place, and a little for its length alone.
    told = counts.groupBy(*keys, "edits", "place").agg(
        (F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n") + 0.05).alias("bits"))
    listed = told.groupBy(*keys, "edits").agg(F.array_sort(F.collect_list(F.struct("place", "bits"))).alias("places"))
    # One entry per character of a title's rest.
    summed = listed.withColumn("sums", F.expr("transform(places, (p, n) -> aggregate(slice(places, 1, n + 1), 0D, (a, x) -> a + x.bits))"))
    raw = F.expr("transform(sequence(0, edits + 1), k -> CASE WHEN k = 0 THEN 0 WHEN k = edits + 1 THEN size(sums) "
                 "ELSE size(filter(sums, s -> s < element_at(sums, -1) * k / (edits + 1))) + 1 END)")
    forward = F.expr("transform(raw, (c, k) -> array_max(transform(sequence(0, k), j -> raw[j] + k - j)))")
    kept = F.expr("transform(forward, (c, k) -> least(c, size(sums) - (edits + 1 - k)))")
    return summed.withColumn("raw", raw).withColumn("forward", forward).select(*keys, kept.alias("cuts"))


def title_meetings(titles: DataFrame, min_similarity: float = V.FUZZY_MIN_SIMILARITY, hot_titles: int = HOT_TITLES) -> DataFrame:
    """Pairs of titles that may be near enough, by shared pieces: system_key, id_i, title_i, id_p, title_p.

    In a band whose longest title has M characters at most d = (1 - min_similarity) * M edits are allowed, so of d + 1
    segments of one title at least one appears unchanged in the other, shifted by at most d. Titles meet on that
    segment. Where more than ``hot_titles`` titles have a segment, that is not enough: without the common piece the two
    rests are still within d edits, so the rests are cut into d + 1 pieces again, at places that tell the
    titles with this segment apart, and titles meet on both pieces. Both steps are exact.
    """
    length = F.length("normalised_title")
    longest = F.floor(length / 4) * 4 + 3
    rows = (titles.select("system_key", "id", "normalised_title")
            .withColumn("bucket", fuzzy_bucket(F.col("normalised_title")))
            .withColumn("numbers", F.array_join(title_numbers(F.col("normalised_title")), "|"))
            .filter(length > 0).withColumn("len", length)
            .withColumn("edits", F.floor(F.lit(1.0 - min_similarity + 1e-9) * longest).cast("int")).withColumn("parts", F.col("edits") + 1)
            # Two different titles within 0 edits do not exist.
            .filter("edits > 0"))

    start, size = _segment_bounds(F.col("len"), F.col("parts"), F.col("segment"))
    indexed = (rows.withColumn("segment", F.explode(F.expr("sequence(0, edits)")))
               .select("system_key", "bucket", "numbers", "segment", F.col("len").alias("indexed_len"),
                       _piece(F.col("normalised_title"), start, size).alias("piece"), "edits", start.alias("at"), size.alias("size"),
                       F.col("id").alias("id_i"), F.col("normalised_title").alias("title_i")))
    other_start, other_size = _segment_bounds(F.col("indexed_len"), F.col("parts"), F.col("segment"))
    band = F.floor(F.col("len") / 4) * 4
    probing = (rows
               .withColumn("indexed_len", F.explode(F.sequence(F.greatest(band, F.lit(1)).cast("int"), F.col("len"))))
               .withColumn("segment", F.explode(F.expr("sequence(0, edits)")))
               .withColumn("shift", F.explode(F.expr("sequence(-edits, edits)")))
               .withColumn("at", other_start + F.col("shift")).withColumn("size", other_size)
               .filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("len")))
               .select("system_key", "bucket", "numbers", "segment", "indexed_len",
                       _piece(F.col("normalised_title"), F.col("at"), F.col("size")).alias("piece"), "edits", "at", "size",
                       F.col("id").alias("id_p"), F.col("normalised_title").alias("title_p")))

    keys = [*_GROUP, "piece"]
    found = ["system_key", "id_i", "title_i", "id_p", "title_p"]
    shared_folder(titles.sparkSession)
    hot = indexed.groupBy(*keys).agg(F.count("*").alias("titles")).filter(F.col("titles") > hot_titles).checkpoint()
    light = probing.select(*keys, "id_p", "title_p").distinct()
    if hot.isEmpty():
        return indexed.join(light, keys).select(found)
    marked = broadcast_if_small(hot.select(keys))
    met = indexed.join(marked, keys, "left_anti").join(light, keys).select(found)

    # Rests of titles with a hot segment, cut where those titles differ.
    cuts = _informative_cuts(indexed.join(marked, keys, "left_semi").withColumn("rest", _without(F.col("title_i"), F.col("at"), F.col("size"))), keys)
    weighed = hot.join(cuts, keys).checkpoint()

    def rests(side: DataFrame, title: str) -> DataFrame:
        own = lookup_join(side, weighed, keys, "titles", "inner", salt_on=[title])
        return (own.withColumn("rest", _without(F.col(title), F.col("at"), F.col("size")))
                .withColumn("second", F.explode(F.expr("sequence(0, edits)")))
                .withColumn("from", F.expr("cuts[second]")).withColumn("width", F.expr("cuts[second + 1] - cuts[second]")))

    one = rests(indexed, "title_i").select(*keys, "second", _piece(F.col("rest"), F.col("from"), F.col("width")).alias("second_piece"), "id_i", "title_i")
    two = (rests(probing, "title_p").withColumn("shift", F.explode(F.expr("sequence(-edits, edits)"))).withColumn("from", F.col("from") + F.col("shift"))
           .filter((F.col("from") >= 0) & (F.col("from") + F.col("width") <= F.length("rest")))
           .select(*keys, "second", _piece(F.col("rest"), F.col("from"), F.col("width")).alias("second_piece"), "id_p", "title_p").distinct())
    return met.unionByName(one.join(two, [*keys, "second", "second_piece"]).select(found))


def fuzzy_title_pairs(titles: DataFrame, min_similarity: float = V.FUZZY_MIN_SIMILARITY,
                      max_bucket: int | None = None, hot_titles: int = HOT_TITLES) -> DataFrame:
    """Near-equal titles of one system: system_key, id_a, id_b, title_a, title_b, similarity.

    ``titles``: system_key, id, normalised_title. Titles compare only inside
    one (system, first letter, length band), and only with equal number runs.
    Every bucket takes part; ``max_bucket`` leaves larger ones out where a caller asks for it.
    Only titles that meet by ``title_meetings`` are measured, each distinct text once, however many rows have it.
    """
    rows = titles.select("system_key", "id", "normalised_title")
    if max_bucket is not None:
        bucketed = rows.withColumn("bucket", fuzzy_bucket(F.col("normalised_title")))
        sizes = bucketed.groupBy("system_key", "bucket").agg(F.count("*").alias("n"))
        rows = (lookup_join(bucketed, sizes, ["system_key", "bucket"], "n", "inner", salt_on=["id"])
                .filter(F.col("n").between(2, max_bucket)).drop("n", "bucket"))
    # Texts are compared, not rows: copies of a title are one row until its pairs are known. Few titles are dealt out too, as each is exploded into many pieces.
    keys = ["system_key", "normalised_title"]
    shared_folder(titles.sparkSession)
    tasks = titles.sparkSession.sparkContext.defaultParallelism
    texts = rows.select(*keys, F.lit(0).alias("id")).distinct().repartition(tasks, *keys).checkpoint()
    met = title_meetings(texts, min_similarity, hot_titles)
    same_length = F.length("title_i") == F.length("title_p")
    # Of different lengths title_i is the shorter one; titles of one length meet both ways.
    near = (met.filter((F.col("title_i") != F.col("title_p")) & (~same_length | (F.col("title_i") < F.col("title_p"))))
            .select("system_key", "title_i", "title_p").distinct()
            .withColumn("similarity", title_similarity(F.col("title_i"), F.col("title_p"))).filter(F.col("similarity") >= min_similarity))
    # Back to ids: each pair of texts stands for all pairs of their rows.
    members = rows.distinct()
    ends = (near.join(members.select("system_key", F.col("normalised_title").alias("title_i"), F.col("id").alias("id_i")), ["system_key", "title_i"])
            .join(members.select("system_key", F.col("normalised_title").alias("title_p"), F.col("id").alias("id_p")), ["system_key", "title_p"])
            .filter(~same_length | (F.col("id_i") != F.col("id_p"))))
    return ends.select("system_key",
                       F.least("id_i", "id_p").alias("id_a"), F.greatest("id_i", "id_p").alias("id_b"),
                       F.when(F.col("id_i") < F.col("id_p"), F.col("title_i")).otherwise(F.col("title_p")).alias("title_a"),
                       F.when(F.col("id_i") < F.col("id_p"), F.col("title_p")).otherwise(F.col("title_i")).alias("title_b"), "similarity")
