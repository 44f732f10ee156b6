"""Near-duplicate components by b-bit MinHash, every link confirmed on the full sets.

Each distinct set of word shingles gets 128 minima. Bands of four whole minima name its buckets; of each minimum
only the lowest four bits are kept and packed, 64 bytes a set. Members of a bucket are candidates:

1. Each bucket links its members to one hub, the member that shares most buckets with others (a family's origin).
   The packed signatures estimate the similarity of such a pair: positions that agree, by bit
   counts, less the share of positions where unequal minima agree by chance. Pairs within five standard
   errors of the threshold are confirmed by exact overlap, and the links are joined to components.
2. Buckets that still hold several components are compared in blocks: members outside the bucket's largest
   component with all members, by longer signatures (1,024 minima of two bits, made for these sets only) and, where
   those leave it open, exactly. Only links that join components leave a block.

So a link between different texts is lost only where no band agrees (at similarity 0.8 less than once
in 10^7) or an estimate is off by more than five standard errors; no bucket is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import settled, stored
from shelfmark.llm.shingle_sets import Joined, WordHashes, confirmed, crossing_links, mixed, rounds, set_ids, shingle_sets, texts_of
from shelfmark.plans.components import connected_components
from shelfmark.plans.skew import lookup_join

#: Words in a shingle and percent of similarity of the operator's own contract.
WORDS, PERCENT = 4, 80
#: Minima of a set, minima in a band, bits kept of each minimum; minima and bits of the longer signatures.
MINIMA, BAND, BITS = 128, 4, 4
MORE_MINIMA, MORE_BITS = 1024, 2
#: Standard errors by which an estimate may fall short of the threshold.
MARGIN = 5.0
#: Sets a task remembers; members on each side of a block of comparisons.
REMEMBERED, SIDE = 500_000, 4096


def minima(values: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """(sets, count): the least value of each set under ``count`` fixed orders of all shingles. Sets may not be empty."""
    begins = np.cumsum(sizes) - sizes
    tags = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    out = np.empty((len(sizes), count), np.uint64)
    for n in range(count):
        out[:, n] = np.minimum.reduceat(values * (tags[2 * n] | np.uint64(1)) + tags[2 * n + 1], begins)
    return out


def band_keys(least: np.ndarray, band: int) -> np.ndarray:
    """(sets, bands): one hash for each ``band`` whole minima."""
    keys = np.broadcast_to(np.arange(least.shape[1] // band, dtype=np.uint64), (len(least), least.shape[1] // band))
    for n in range(band):
        keys = mixed(keys + least[:, n::band][:, :keys.shape[1]]) + np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def packed(least: np.ndarray, bits: int) -> np.ndarray:
    """(sets, words): the lowest ``bits`` bits of each minimum, packed into 64-bit words."""
    each = 64 // bits
    low = (mixed(least) & np.uint64((1 << bits) - 1)).reshape(len(least), least.shape[1] // each, each)
    return np.bitwise_or.reduce(low << (np.arange(each, dtype=np.uint64) * np.uint64(bits)), axis=2).view(np.int64)


def least_agreement(percent: int, count: int, bits: int) -> float:
    """The fewest agreeing positions of a pair at the threshold, less ``MARGIN`` standard errors.

    Unequal minima agree by chance in 2^-bits of the positions; an estimate of the similarity
    is (agreeing share - chance) / (1 - chance), and this is the same test before that correction.
    """
    chance = 2.0 ** -bits
    share = chance + (1 - chance) * percent / 100
    return count * (share - MARGIN * (share * (1 - share) / count) ** 0.5)


def agreement(one: str, two: str, count: int, bits: int) -> Column:
    """Positions in which two packed signatures (arrays of 64-bit words) agree, by bit counts."""
    ones = sum(1 << n for n in range(0, 64, bits))
    ones -= (ones >> 63) << 64
    total = F.lit(count)
    for n in range(count * bits // 64):
        word = F.col(one)[n].bitwiseXOR(F.col(two)[n])
        step = 1
        while step < bits:
            word = word.bitwiseOR(F.shiftrightunsigned(word, step))
            step *= 2
        total = total - F.bit_count(word.bitwiseAND(ones))
    return total


def _lists(rows: np.ndarray, present: np.ndarray):
    """A list column: the rows of a matrix where ``present``, empty lists elsewhere."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(present * rows.shape[1])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.reshape(-1), pa.int64()))


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, sid, n, keys, signature) of ``docs`` (doc_id, text as bytes); the first of equal sets in a task carries the lists."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, seen = WordHashes(), set()
        for batch in batches:
            for ids, texts in rounds(batch):
                values, sizes = shingle_sets(texts, words, known)
                sids = set_ids(values, sizes)
                fresh = np.zeros(len(sids), bool)
                for n, sid in enumerate(sids.tolist()):
                    if sizes[n] and sid not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(sid)
                        fresh[n] = True
                least = minima(values[np.repeat(fresh, sizes)], sizes[fresh], MINIMA) if fresh.any() else np.zeros((0, MINIMA), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sids), pa.array(sizes), _lists(band_keys(least, BAND), fresh), _lists(packed(least, BITS), fresh)],
                    ["doc_id", "sid", "n", "keys", "signature"])

    return docs.mapInArrow(run, "doc_id long, sid long, n long, keys array<long>, signature array<long>")


def payloads(texts: DataFrame, words: int) -> DataFrame:
    """(sid, signature, block): 1,024 minima of two bits of each set, and its shingles as packed 64-bit hashes."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            for sids, found in rounds(batch):
                values, sizes = shingle_sets(found, words, known)
                keep = set_ids(values, sizes) == np.array(sids, np.int64)
                if keep.any():
                    values, sizes = values[np.repeat(keep, sizes)], sizes[keep]
                    ends = np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(sids, np.int64)[keep]),
                         pa.array([row.tobytes() for row in packed(minima(values, sizes, MORE_MINIMA), MORE_BITS)], pa.binary()),
                         pa.array([values[end - size:end].tobytes() for end, size in zip(ends, sizes, strict=True)], pa.binary())], ["sid", "signature", "block"])

    return texts.mapInArrow(run, "sid long, signature binary, block binary").dropDuplicates(["sid"])


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, sid, members) of the buckets that hold several sets."""
    entries = classes.select("sid", F.explode("keys").alias("key"))
    counts = settled(entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    return stored(lookup_join(entries, counts, ["key"], "members", "inner", salt_on=["sid"]), "buckets")


def hub_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each bucket's hub and the members whose estimated similarity to it is not clearly too low."""
    shared = members.groupBy("sid").agg(F.sum("members").alias("shared"))
    hubs = members.join(shared, "sid").groupBy("key").agg(F.max(F.struct("shared", "sid")).alias("hub"), F.count("*").alias("members"))
    signatures = classes.select("sid", "signature")
    known = settled(hubs.select("key", F.col("hub.sid").alias("a"), "members")
                    .join(signatures.toDF("a", "signature_a"), "a").select("key", "a", "signature_a", "members"))
    rows = lookup_join(members.select("key", "sid").join(signatures, "sid"), known, ["key"], "members", "inner", salt_on=["sid"])
    return (rows.filter(F.col("a") != F.col("sid"))
            .filter(agreement("signature", "signature_a", MINIMA, BITS) >= least_agreement(percent, MINIMA, BITS))
            .select("a", F.col("sid").alias("b")).distinct())


def crossing(members: DataFrame, state: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``crossing_links`` by the longer signatures, and exactly where those are not clearly too unlike."""
    least, ones = least_agreement(percent, MORE_MINIMA, MORE_BITS), np.uint64(sum(1 << n for n in range(0, 64, MORE_BITS)))

    def links(block):
        joined = Joined()
        sids, comps, sets = block["sid"].tolist(), block["comp"].tolist(), [np.frombuffer(x, np.uint64) for x in block["block"]]
        signatures = np.frombuffer(b"".join(block["signature"]), np.uint64).reshape(len(sids), -1)
        numbers, rights = np.array([len(x) for x in sets]), np.flatnonzero(block["is_right"].to_numpy())
        for n in np.flatnonzero(block["is_left"].to_numpy()).tolist():
            apart = signatures[rights] ^ signatures[n]
            step = 1
            while step < MORE_BITS:
                apart |= apart >> np.uint64(step)
                step *= 2
            agree = MORE_MINIMA - np.bitwise_count(apart & ones).sum(axis=1, dtype=np.int64)
            near = (agree >= least) & (100 * np.minimum(numbers[rights], numbers[n]) >= percent * np.maximum(numbers[rights], numbers[n]))
            # The likeliest first, so that one link spares the rest of its component.
            for m in rights[near][np.argsort(-agree[near], kind="stable")].tolist():
                one, two = joined.root(comps[n]), joined.root(comps[m])
                if one != two:
                    shared = len(np.intersect1d(sets[n], sets[m], assume_unique=True))
                    if 100 * shared >= percent * (len(sets[n]) + len(sets[m]) - shared):
                        joined.join(one, two)
                        yield sids[n], sids[m]

    return crossing_links(members, state, lambda sids: payloads(texts_of(sids, docs, classes), words), links, SIDE)[0].select("a", "b")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), kept.

    A null or empty text has no shingles and is linked with nothing. Equal sets are linked. Rows that repeat a doc_id
    are judged each by its own text. A row with a null doc_id links nothing, has component_id null and is kept.
    ``kept``: the document has its component's smallest id. No rows give no rows; further columns are ignored; texts are
    taken whole at any length. ``percent`` may be 50 to 100; the bands are laid out for 80 and more.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = stored(signed(plain, words), "signed")
    classes = stored(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sid").agg(
        F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.max("keys").alias("keys"), F.max("signature").alias("signature")), "classes")
    chosen = plain.filter("doc_id IS NOT NULL")
    members = bucket_members(classes)
    links = confirmed(hub_pairs(members, classes, percent), chosen, classes, words, percent)
    first = settled(connected_components(settled(links), "a", "b"))
    state = settled(classes.select("sid").join(first.select(F.col("node").alias("sid"), "root"), "sid", "left")
                    .select("sid", F.coalesce("root", "sid").alias("comp")))
    more = settled(crossing(members, state, chosen, classes, words, percent))
    if not more.isEmpty():
        between = more.join(state.toDF("a", "comp_a"), "a").join(state.toDF("b", "comp_b"), "b").filter("comp_a <> comp_b")
        above = connected_components(between, "comp_a", "comp_b").select(F.col("node").alias("comp"), "root")
        state = settled(state.join(above, "comp", "left").select("sid", F.coalesce("root", "comp").alias("comp")))
    member = classes.select("sid", "doc").join(state, "sid")
    smallest = settled(member.groupBy("comp").agg(F.min("doc").alias("component_id"), F.count("*").alias("sets")))
    named = lookup_join(member, smallest, ["comp"], "sets", "inner", salt_on=["sid"]).select("sid", "component_id", F.lit(1).alias("there"))
    copies = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sid").agg(F.count("*").alias("copies"))
    joined = lookup_join(rows.select("doc_id", "sid", "n"), named.join(copies, "sid"), ["sid"], "copies", "left", salt_on=["doc_id"])
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op13_minhash_dedup(docs: DataFrame) -> DataFrame:
    return components(docs)
