"""Sets of word shingles as sorted 64-bit hashes, and links between them confirmed on the full sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import settled, stored
from shelfmark.plans.skew import broadcast_if_small, lookup_join

#: Words in one round of array work; members on each side of a block of comparisons; rows in a shard of blocks.
ROUND, SIDE, SHARD = 1 << 18, 4096, 8_000
#: Rows of (doc_id, set) that may be broadcast (16 bytes each); pairs of one set that meet in one group.
INVOLVED, SALT = 1_000_000, 2000


class WordHashes(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted distinct shingles of each text, one after the other; all words as one where there are fewer."""
    found = [text.lower().split() for text in texts]
    counts = np.array([len(f) for f in found], np.int64)
    hashes = np.fromiter((known[word] for f in found for word in f), np.uint64, int(counts.sum()))
    length = np.minimum(counts, words)
    made = np.where(counts > 0, counts - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), made)
    at = np.arange(len(owner)) + np.repeat((np.cumsum(counts) - counts) - (np.cumsum(made) - made), made)
    size = length[owner]
    value = size.astype(np.uint64)
    for step in range(words):
        there = size > step
        value[there] = mixed(value[there] + hashes[at[there] + step]) + np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, bool)
    return value[fresh], np.bincount(owner[fresh], minlength=len(texts)).astype(np.int64)


def set_ids(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set; 0 for an empty one."""
    sums = np.zeros(len(sizes) + 1, np.uint64)
    full = np.flatnonzero(sizes)
    begins = np.cumsum(sizes) - sizes
    if len(full):
        sums[full] = np.add.reduceat(mixed(values), begins[full])
    out = mixed(sums[:-1] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    return np.where(sizes > 0, out, 0)


def rounds(batch) -> Iterator[tuple[list, list[bytes]]]:
    """(first column, texts) of a batch in rounds of bounded size, a longer text in a round of its own."""
    firsts, texts, held = [], [], 0
    for first, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py()
        if texts and held + len(text) > 6 * ROUND:
            yield firsts, texts
            firsts, texts, held = [], [], 0
        firsts.append(first)
        texts.append(text)
        held += len(text)
    if texts:
        yield firsts, texts


def texts_of(sids: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(sid, text) of one document of each set; a repeated doc_id may bring other texts along, which their readers tell by the hash."""
    named = settled(sids.select("sid").distinct().join(classes.select("sid", F.col("doc").alias("doc_id")), "sid"))
    return docs.join(broadcast_if_small(named, INVOLVED), "doc_id").select("sid", "text")


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(sid, block): each set's shingles as packed 64-bit hashes."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            for sids, found in rounds(batch):
                values, sizes = shingle_sets(found, words, known)
                keep = np.flatnonzero(set_ids(values, sizes) == np.array(sids, np.int64))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(sids, np.int64)[keep]),
                                                  pa.array([values[ends[n] - sizes[n]:ends[n]].tobytes() for n in keep], pa.binary())], ["sid", "block"])

    return texts.mapInArrow(run, "sid long, block binary").dropDuplicates(["sid"])


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough. A set with many pairs is sent once for each ``SALT`` of them, not with each."""
    sizes = classes.select("sid", "n")
    pairs = settled(pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
                    .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b"))
    sets = stored(full_sets(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")), docs, classes), words), "sets")
    hubs = settled(pairs.groupBy("a").agg((1 + F.count("*") / SALT).cast("int").alias("salts"), F.count("*").alias("times")))
    left = (hubs.join(sets, hubs["a"] == sets["sid"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                                             F.lit(0).cast("long").alias("b"), F.lit(0).alias("member"), "block"))
    dealt = lookup_join(pairs, hubs, ["a"], "times", "inner", salt_on=["a", "b"])
    right = (dealt.join(sets.withColumnRenamed("sid", "b"), "b")
             .select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", F.lit(1).alias("member"), "block"))
    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(frames: Iterator) -> Iterator:
        known = np.zeros(0, np.uint64)
        for frame in frames:
            keep = np.zeros(len(frame), bool)
            for n, (member, block) in enumerate(zip(frame["member"], frame["block"], strict=True)):
                other = np.frombuffer(block, np.uint64)
                if not member:
                    known = other
                else:
                    shared = len(np.intersect1d(known, other, assume_unique=True))
                    keep[n] = 100 * shared >= percent * (len(known) + len(other) - shared)
            yield frame.loc[keep, ["a", "b"]]

    return rows.mapInPandas(run, "a long, b long")


def crossing_links(members: DataFrame, state: DataFrame, carry: Callable[[DataFrame], DataFrame], links: Callable,
                   side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """(a, b, key): links that join components which groups of candidates still hold; and the groups (key, sid) that were compared.

    ``members``: key, sid; ``state``: sid, comp.

    The groups with one largest component are taken together. Sets outside that component are compared with all sets, by
    ``links``, which is given a block (sid, comp, is_left, is_right and what ``carry`` adds to the sets' sid) and yields confirmed links. A
    block holds at most about ``side`` sets on each side, and its sets travel with it, so no pair ever leaves a task but a link.
    """
    rows = stored(members.select("key", "sid").join(state, "sid"), "places")
    split = (rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
             .groupBy("key").agg(F.sum("n").alias("members"), F.max_by("comp", F.struct("n", "comp")).alias("major"), F.count("*").alias("comps"))
             .filter("comps > 1").select("key", "members", "major"))
    grouped = stored(lookup_join(rows, settled(split), ["key"], "members", "inner", salt_on=["sid"]).select("major", "sid", "comp").distinct(), "groups")
    sizes = settled(grouped.groupBy("major").agg(F.count("*").alias("sets"), F.ceil(F.count_if(F.col("comp") != F.col("major")) / side).cast("int").alias("lefts"),
                                                 F.ceil(F.count("*") / side).cast("int").alias("rights")))
    carried = stored(carry(grouped), "payloads")
    dealt = (lookup_join(grouped, sizes, ["major"], "sets", "inner", salt_on=["sid"])
             .withColumn("left", F.when(F.col("comp") != F.col("major"), F.pmod(F.xxhash64("sid"), F.col("lefts")).cast("int")).otherwise(-1))
             .withColumn("right", F.pmod(F.xxhash64("sid"), F.col("rights")).cast("int")))
    # Row ``left`` of the blocks for a set outside of the largest component, column ``right`` for any set.
    blocks = F.expr("""array_distinct(concat(
        CASE WHEN left >= 0 THEN transform(sequence(0, rights - 1), j -> struct(left AS i, j AS j)) ELSE array() END,
        transform(sequence(0, lefts - 1), i -> struct(i AS i, right AS j))))""")
    placed = (dealt.select("major", "sid", "comp", "left", "right", F.explode(blocks).alias("at"))
              .select("major", "sid", "comp", (F.col("left") == F.col("at.i")).alias("is_left"), (F.col("right") == F.col("at.j")).alias("is_right"), "at.i", "at.j"))
    shards = max(8, grouped.count() // SHARD)
    full = placed.join(carried, "sid").withColumn("shard", F.pmod(F.xxhash64("major", "i", "j"), F.lit(shards)).cast("int"))

    def run(frame):
        import pandas as pd

        found = [(*link, at[0]) for at, block in frame.groupby(["major", "i", "j"], sort=False) for link in links(block)]
        return pd.DataFrame(found, columns=["a", "b", "key"]).astype("int64")

    return full.groupBy("shard").applyInPandas(run, "a long, b long, key long"), grouped.select(F.col("major").alias("key"), "sid")


class Joined:
    """Components of one block, as far as its links join them."""

    def __init__(self):
        self.above = {}

    def root(self, comp):
        while comp in self.above:
            comp = self.above[comp]
        return comp

    def join(self, one, two):
        self.above[max(one, two)] = min(one, two)
