"""Exact Jaccard self-join on word shingles by partitions of the universe.

Sets are put into size bands; two linked sets lie in one band or in neighbouring ones.
For each pair of neighbouring bands the universe of shingles is split by hash into
H + 1 segments, H being the largest symmetric difference that a linked pair of these sizes
can have, so at least one segment of a linked pair is equal (pigeonhole). The hash
of each segment's subset is a signature; sets that share one are candidates.

Allocation by cost: what a signature costs is the number of sets on its list, and a subset is on a list no shorter than
that of its rarest shingle. A first pass over all texts counts the shingles that many sets have. A subset with nothing but such shingles, or with
hardly any, is not indexed: its list would be longer than a neighbourhood. In its stead the next segment is indexed with its
one-deletion neighbourhood (the subset and all subsets that lack one shingle),
which finds that segment at a difference of one. Whether a subset is left out depends on the subset alone, so a segment
that is equal in both sets shifts the same unit of difference to the same next segment in both, and the
pigeonhole count, and with it exactness, holds whatever was counted.

Each bucket names its members to one centre, and the candidates of a centre are compared in blocks. There a set is a bitmap of a few bits for
each shingle, which says whether an odd number of its shingles fall on a bit: a shingle that only one of two sets has turns one bit, so
the bits in which two sets differ are never more than their symmetric difference, and no link is missed. Only pairs that join components leave the
block; these are confirmed on the whole hashes, and where one fails, the sets that it joined in its group are compared again by an index of three bytes
of each hash, by which an overlap can only come out too large; should one fail even then, by the whole hashes. A centre with more candidates than
a block holds is linked with them first. So every candidate pair is either verified or already in one component, and no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import settled, shards_for, stored
from shelfmark.llm.shingle_sets import (SIDE, Joined, WordHashes, confirmed, crossing_links, full_sets, mixed, rounds, set_ids, shingle_sets,
                                        texts_of)
from shelfmark.plans.components import connected_components
from shelfmark.plans.skew import broadcast_if_small, lookup_join

#: Words in a shingle and percent of similarity of the operator's own contract.
WORDS, PERCENT = 4, 85
#: Subsets up to this size are not indexed by themselves.
THIN = 1
#: Sets with a shingle from which on it counts as frequent, in a round of one task and in all; frequent shingles that are told to the tasks (8 bytes each).
SEEN, LIST, FREQUENT = 3, 12, 200_000
#: Bytes of text for each shard of signatures; entries a task packs at a time; sets a task remembers.
SHARD_BYTES, ENTRIES, REMEMBERED = 8 << 20, 250_000, 500_000
#: Bits of a bitmap for each shingle, at least.
SPARSE = 4
_ENTRY = 17


def bands(percent: int, largest: int) -> np.ndarray:
    """Lower bounds of the size bands, such that a linked partner is at most one band away."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds + [bounds[-1] * 100 // percent + 1, bounds[-1] * 10000 // percent**2 + 2])


def segments(bounds: np.ndarray, band: int, percent: int) -> int:
    """H + 1 for pairs whose smaller set lies in ``band``."""
    smaller = int(bounds[band + 1]) - 1
    return (100 - percent) * (smaller + smaller * 100 // percent) // (100 + percent) + 1


def segment_counts(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower bounds of the size bands, segments of each pair of bands), for sets of any size."""
    bounds = bands(percent, 1 << 40) if percent < 100 else np.array([1, 1 << 41, 1 << 42])
    return bounds, np.array([segments(bounds, band, percent) for band in range(len(bounds) - 1)], np.int64)


def signatures(values: np.ndarray, sizes: np.ndarray, config: np.ndarray, counts: np.ndarray, thin: int, frequent: np.ndarray):
    """(signature, number of the set) of many sets, each under the segments of its pair of bands ``config``.

    ``values``: the sets' shingles one after the other, ``sizes`` of them each; ``frequent``: sorted shingles of long lists.
    """
    count = counts[config]
    base = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(sizes)), sizes)
    slot = base[owner] + ((values >> np.uint64(20)) % count[owner].astype(np.uint64)).astype(np.int64)
    total = int(count.sum())
    order = np.argsort(slot, kind="stable")
    hashed = mixed(values)[order]
    held = np.bincount(slot, minlength=total)
    begins = np.cumsum(held) - held
    sums = np.zeros(total, np.uint64)
    full = held > 0
    if len(hashed):
        sums[full] = np.add.reduceat(hashed, begins[full])
    rare = np.ones(len(values), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rare = frequent[at] != values
    plain = (held > thin) & (np.bincount(slot[rare], minlength=total) > 0)
    of_set = np.repeat(np.arange(len(sizes)), count)
    segment = np.arange(total) - base[of_set]
    tags = mixed(segment.astype(np.uint64) + (config[of_set].astype(np.uint64) << np.uint64(40)))
    left_out = np.flatnonzero(~plain)
    target = base[of_set[left_out]] + (segment[left_out] + 1) % count[of_set[left_out]]
    more = held[target]
    element = np.repeat(begins[target], more) + np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    salt = np.uint64(0x632BE59BD9B4E019)
    out = [mixed(sums[plain] + tags[plain]), mixed(sums[target] + tags[target] + salt),
           mixed(np.repeat(sums[target] + tags[target], more) - hashed[element] + salt)]
    return np.concatenate(out), np.concatenate([of_set[plain], of_set[target], np.repeat(of_set[target], more)])


def measured_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, sid, n, block): the hash and size of each document's set; rows with ``block`` hold shingles that several sets of a round have, and how many."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, seen = WordHashes(), set()
        for batch in batches:
            for ids, texts in rounds(batch):
                values, sizes = shingle_sets(texts, words, known)
                sids = set_ids(values, sizes)
                fresh = np.zeros(len(sids), bool)
                for n, sid in enumerate(sids.tolist()):
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    fresh[n] = sid not in seen
                    seen.add(sid)
                shingle, times = np.unique(values[np.repeat(fresh, sizes)], return_counts=True)
                several = times >= SEEN
                block = shingle[several].tobytes() + times[several].astype(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([*ids, None], pa.int64()), pa.array([*sids.tolist(), 0], pa.int64()), pa.array([*sizes.tolist(), 0], pa.int64()),
                                                  pa.array([*[None] * len(ids), block], pa.binary())], ["doc_id", "sid", "n", "block"])

    return docs.mapInArrow(run, "doc_id long, sid long, n long, block binary")


def frequent_shingles(measured: DataFrame) -> np.ndarray:
    """Sorted shingles that at least ``LIST`` sets have, as far as rounds told; the ``FREQUENT`` most frequent ones at most.

    They only say which lists would be long, so what is left out here costs time and no link.
    """
    def unpack(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for block in frame["block"]:
                half = len(block) // 2
                yield pd.DataFrame({"shingle": np.frombuffer(block[:half], np.int64), "times": np.frombuffer(block[half:], np.int64)})

    told = (measured.filter("block IS NOT NULL").select("block").mapInPandas(unpack, "shingle long, times long")
            .groupBy("shingle").agg(F.sum("times").alias("times")).filter(F.col("times") >= LIST).orderBy(F.desc("times"), "shingle").limit(FREQUENT))
    return np.sort(np.array([row.shingle for row in told.select("shingle").collect()], np.int64).view(np.uint64))


def packed_signatures(docs: DataFrame, words: int, percent: int, thin: int, shards: int, frequent: np.ndarray) -> DataFrame:
    """(shard, block): signatures with the set they belong to and its role (0 lower band, 1 upper band)."""
    bounds, counts = segment_counts(percent)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        known, seen, held, total = WordHashes(), set(), [], 0

        def flush():
            sig, sid, role = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            shard = (sig % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            sig, sid, role, shard = sig[order], sid[order], role[order], shard[order]
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            return pa.RecordBatch.from_pandas(pd.DataFrame(
                [(int(shard[i]), sig[i:j].tobytes() + sid[i:j].tobytes() + role[i:j].tobytes())
                 for i, j in zip(edges[:-1], edges[1:], strict=True)], columns=["shard", "block"]).astype({"shard": "int32"}), preserve_index=False)

        for batch in batches:
            for _, texts in rounds(batch):
                values, sizes = shingle_sets(texts, words, known)
                sids = set_ids(values, sizes)
                keep = np.zeros(len(sids), bool)
                for n, sid in enumerate(sids.tolist()):
                    # A copy in the same task has sent the same signatures.
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    keep[n] = sizes[n] > 0 and sid not in seen
                    seen.add(sid)
                values, sizes, sids = values[np.repeat(keep, sizes)], sizes[keep], sids[keep]
                band = np.searchsorted(bounds, sizes, side="right") - 1
                for config, role in ((band, 0), (band - 1, 1)):
                    # One segment: only equal sets are linked.
                    use = (config >= 0) & (counts[np.maximum(config, 0)] > 1)
                    if use.any():
                        sig, number = signatures(values[np.repeat(use, sizes)], sizes[use], config[use], counts, thin, frequent)
                        held.append((sig, sids[use][number], np.full(len(sig), role, np.uint8)))
                        total += len(sig)
                if total >= ENTRIES:
                    total = 0
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.lit(0).alias("none"), "text").mapInArrow(run, "shard int, block binary")


def _buckets(blocks):
    """Entries sorted by signature, role and set, without repeats, of buckets that hold a pair; group number of each."""
    sizes = [len(block) // _ENTRY for block in blocks]
    sig = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blocks, sizes, strict=True)])
    sid = np.concatenate([np.frombuffer(b, np.int64, n, 8 * n) for b, n in zip(blocks, sizes, strict=True)])
    role = np.concatenate([np.frombuffer(b, np.uint8, n, 16 * n) for b, n in zip(blocks, sizes, strict=True)])
    order = np.argsort(sig, kind="stable")
    ordered = sig[order]
    same = ordered[1:] == ordered[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order = order[several]
    sig, sid, role = sig[order], sid[order], role[order]
    order = np.lexsort((sid, role, sig))
    sig, sid, role = sig[order], sid[order], role[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])]) if len(sig) else np.zeros(0, bool)
    sig, sid, role = sig[fresh], sid[fresh], role[fresh]
    opens = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    group = np.cumsum(opens) - 1
    sizes = np.bincount(group) if len(group) else np.zeros(0, int)
    keep = ((sizes > 1) & (role[opens] == 0))[group] if len(group) else opens
    sid, role, opens = sid[keep], role[keep], opens[keep]
    return sid, role, np.cumsum(opens) - 1, opens


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(low) else np.zeros(0, bool)
    return low[fresh], high[fresh]


def centre_pairs(packed: DataFrame) -> DataFrame:
    """(a, b): each bucket's centre with its members, once per shard."""
    def run(frame):
        import pandas as pd

        sid, _, group, opens = _buckets(list(frame["block"]))
        a, b = sid[opens][group][~opens], sid[~opens]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        return pd.DataFrame({"a": a[fresh], "b": b[fresh]})

    return packed.groupBy("shard").applyInPandas(run, "a long, b long").distinct()


def parity_sets(texts: DataFrame, words: int) -> DataFrame:
    """(sid, block): a bitmap of each set, at least ``SPARSE`` bits (a power of two) for a shingle; a bit is set where an odd number of shingles fall on it."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            for sids, found in rounds(batch):
                values, sizes = shingle_sets(found, words, known)
                keep = np.flatnonzero(set_ids(values, sizes) == np.array(sids, np.int64))
                ends = np.cumsum(sizes)
                blocks = [parities(values[ends[n] - sizes[n]:ends[n]]).tobytes() for n in keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(sids, np.int64)[keep]), pa.array(sizes[keep]), pa.array(blocks, pa.binary())], ["sid", "n", "block"])

    return texts.mapInArrow(run, "sid long, n long, block binary").dropDuplicates(["sid"])


def parities(values: np.ndarray) -> np.ndarray:
    """The bitmap of one set as 64-bit words."""
    bits = 1 << max(6, (SPARSE * len(values) - 1).bit_length())
    odd = (np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one a row) as they would be with fewer bits."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def short_sets(texts: DataFrame, words: int) -> DataFrame:
    """(sid, block): each set's shingles as the lowest three bytes of their hashes, sorted, repeats kept."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            for sids, found in rounds(batch):
                values, sizes = shingle_sets(found, words, known)
                keep = np.flatnonzero(set_ids(values, sizes) == np.array(sids, np.int64))
                ends, short = np.cumsum(sizes), (values & np.uint64(0xFFFFFF)).astype("<u4")
                blocks = [np.sort(short[ends[n] - sizes[n]:ends[n]]).view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for n in keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(sids, np.int64)[keep]), pa.array(blocks, pa.binary())], ["sid", "block"])

    return texts.mapInArrow(run, "sid long, block binary").dropDuplicates(["sid"])


def _hashes(block: bytes, short: bool) -> np.ndarray:
    if not short:
        return np.frombuffer(block, np.uint64)
    wide = np.zeros((len(block) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(block, np.uint8).reshape(-1, 3)
    return wide.view("<u4").reshape(-1)


def joining(block, near: Callable[[int], list[int]], rights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of sets that join components of a block; ``near`` gives the places in ``rights`` of the sets that are linked with a left one."""
    joined = Joined()
    sids, comps = block["sid"].tolist(), block["comp"].tolist()
    is_left, is_right = block["is_left"].to_numpy(), block["is_right"].to_numpy()
    lefts = np.flatnonzero(is_left)
    # Where every left set is a right one too, a pair is tested by either end, so one component need not test its members.
    mutual, others = bool(is_right[lefts].all()), {comps[m] for m in np.flatnonzero(is_right & ~is_left).tolist()}
    main, most = None, 1
    for n in lefts.tolist():
        if mutual and main is not None and joined.root(comps[n]) == joined.root(main) and all(joined.root(c) == joined.root(main) for c in others):
            continue
        found = near(n)
        if len(found) > most:
            main, most = comps[n], len(found)
        for m in found:
            one, two = joined.root(comps[n]), joined.root(comps[rights[m]])
            if one != two:
                joined.join(one, two)
                yield sids[n], sids[rights[m]]


def parity_links(percent: int):
    """Links within one block by the bitmaps of ``parity_sets``, to be confirmed; for ``crossing_links``."""
    def links(block):
        bitmaps, sizes = [np.frombuffer(x, np.uint64) for x in block["block"]], block["n"].to_numpy()
        rights = np.flatnonzero(block["is_right"].to_numpy())
        lengths = np.array([len(bitmaps[m]) for m in rights])
        # Bitmaps of one length together, and how they look with fewer bits, made when first asked for.
        places = {int(words): np.flatnonzero(lengths == words) for words in np.unique(lengths)}
        whole = {words: np.stack([bitmaps[rights[m]] for m in at]) for words, at in places.items()}
        shorter = {}

        def near(n):
            out = []
            for words, at in places.items():
                size = sizes[rights[at]]
                # As alike in size as a link has to be.
                alike = 100 * np.minimum(size, sizes[n]) >= percent * np.maximum(size, sizes[n])
                if not alike.any():
                    continue
                width = min(words, len(bitmaps[n]))
                if (words, width) not in shorter:
                    shorter[words, width] = folded(whole[words], width)
                apart = np.bitwise_count(shorter[words, width] ^ folded(bitmaps[n][None], width)).sum(axis=1, dtype=np.int64)
                out.append(at[alike & ((100 + percent) * apart <= (100 - percent) * (size + sizes[n]))])
            return np.concatenate(out).tolist() if out else []

        yield from joining(block, near, rights)

    return links


def overlap_links(percent: int, short: bool):
    """Links within one block by an index of its shingles; for ``crossing_links``.

    With ``short`` hashes an overlap can only come out too large, so no link is missed, but what is found has to be confirmed.
    """
    def links(block):
        sets = [_hashes(x, short) for x in block["block"]]
        rights = np.flatnonzero(block["is_right"].to_numpy())
        sizes = np.array([len(sets[m]) for m in rights])
        shingle = np.concatenate([sets[m] for m in rights])
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], np.repeat(np.arange(len(rights)), sizes)[order]

        def near(n):
            low = np.searchsorted(shingle, sets[n], "left")
            many = np.searchsorted(shingle, sets[n], "right") - low
            at = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            shared = np.bincount(owner[at], minlength=len(rights))
            return np.flatnonzero(100 * shared >= percent * (sizes + len(sets[n]) - shared)).tolist()

        yield from joining(block, near, rights)

    return links


def with_links(state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` (sid, comp) after its components are joined by ``links`` (a, b)."""
    between = settled(links.join(state.toDF("a", "comp_a"), "a").join(state.toDF("b", "comp_b"), "b").filter("comp_a <> comp_b").select("comp_a", "comp_b").distinct())
    above = connected_components(between, "comp_a", "comp_b").select(F.col("node").alias("comp"), "root")
    return settled(state.join(above, "comp", "left").select("sid", F.coalesce("root", "comp").alias("comp")))


def misled(groups: DataFrame, state: DataFrame, named: DataFrame, wrong: DataFrame) -> DataFrame:
    """(key, sid): what ``groups`` have to compare again, after some of the links ``named`` in them turned out ``wrong``.

    Within a group every pair that looked like a link lies in one component of the group's named links, so only
    the components with a wrong link can hide a right one; each is a group of its own.
    """
    ends = (named.join(state.toDF("a", "comp_a"), "a").join(state.toDF("b", "comp_b"), "b")
            .select("key", "a", "b", F.xxhash64("key", "comp_a").alias("one"), F.xxhash64("key", "comp_b").alias("two")))
    ends = settled(ends)
    placed = settled(connected_components(ends, "one", "two"))
    doubtful = (ends.join(wrong, ["key", "a", "b"], "left_semi").select(F.col("one").alias("node")).distinct()
                .join(placed, "node").select("root").distinct())
    again = placed.join(doubtful, "root", "left_semi")
    return (groups.join(state, "sid").select("sid", F.xxhash64("key", "comp").alias("node")).join(again, "node")
            .select(F.col("root").alias("key"), "sid").distinct())


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, thin: int = THIN) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    A null or empty text has no shingles and is linked with nothing, not even with another
    empty one. Equal sets are one class and linked. Rows that repeat a doc_id are
    judged each by its own text. A row with a null doc_id has component_id null and links nothing.
    No rows give no rows; further columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    measured = stored(measured_sets(plain, words), "measured")
    sets = measured.filter("block IS NULL").select("doc_id", "sid", "n")
    classes = settled(sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.count("*").alias("copies")))
    chosen = plain.filter("doc_id IS NOT NULL")
    packed = packed_signatures(chosen, words, percent, thin, shards_for(total, SHARD_BYTES), frequent_shingles(measured))
    pairs = settled(centre_pairs(packed))
    # All candidates of a centre, itself included.
    members = pairs.select(F.col("a").alias("key"), F.col("b").alias("sid")).unionByName(pairs.select(F.col("a").alias("key"), F.col("a").alias("sid")).distinct())
    state = classes.select("sid", F.col("sid").alias("comp"))
    # A centre with more candidates than a block holds is linked with them first, so that few of them are left to compare.
    large = settled(pairs.groupBy("a").agg(F.count("*").alias("times")).filter(F.col("times") > SIDE))
    links = settled(confirmed(lookup_join(pairs, large, ["a"], "times", "inner", salt_on=["b"]).select("a", "b"), chosen, classes, words, percent))
    if not links.isEmpty():
        state = with_links(state, links)
    # Where bitmaps, or short hashes, took a pair for a link that is none, the sets it joined are compared again, at last by the whole hashes.
    for carried, linked, sure in ((parity_sets, parity_links(percent), False), (short_sets, overlap_links(percent, True), False),
                                  (full_sets, overlap_links(percent, False), True)):
        named, groups = crossing_links(members, state, lambda sids, carried=carried: carried(texts_of(sids, chosen, classes), words), linked)
        named = settled(named)
        if sure:
            state = with_links(state, named.select("a", "b"))
            break
        right = settled(confirmed(named.select("a", "b").distinct(), chosen, classes, words, percent))
        wrong = settled(named.join(right, ["a", "b"], "left_anti"))
        if not wrong.isEmpty():
            members = settled(misled(groups, state, named, wrong))
        state = with_links(state, right)
        if wrong.isEmpty():
            break
    member = classes.select("sid", "doc", "copies").join(state, "sid")
    smallest = settled(member.groupBy("comp").agg(F.min("doc").alias("component_id"), F.count("*").alias("sets")))
    named = lookup_join(member, smallest, ["comp"], "sets", "inner", salt_on=["sid"]).select("sid", "component_id", "copies")
    linked = lookup_join(sets, named, ["sid"], "copies", "left", salt_on=["doc_id"])
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
                         .otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns.

    Rows that repeat a doc_id with different texts all stay if one of them does, so no text without a copy is lost.
    """
    gone = settled(components(docs, words, percent).filter("doc_id IS NOT NULL").groupBy("doc_id")
                   .agg(F.min((F.col("doc_id") != F.col("component_id")).cast("int")).alias("all_gone")).filter("all_gone = 1").select("doc_id"))
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)


def op4_jaccard_join(docs: DataFrame) -> DataFrame:
    return components(docs)
