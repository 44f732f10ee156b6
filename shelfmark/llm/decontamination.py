"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words that ignores some positions, so
that a replaced word does not hide an overlap. Seeds of benchmark items and of
documents are joined; hits that lie on one alignment (document position - item
position) are one candidate; each candidate is then compared word by word along
its alignment, and the longest stretch in which at least ``share`` of the words
agree decides. Document seeds are first held against a bitmap of the benchmark's
seeds (at most 16 MB), so that nearly all of them never leave their task; the
bitmap lets no true hit go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import settled, texts
from shelfmark.plans.skew import broadcast_if_small

# Masks of weight 6; a 1 compares the word, a 0 ignores it. Every way to replace 2 of 13, 3 of 15, 4 of 20
# or 5 of 25 words leaves a place for one of them, and each overlap of 13 words or more that is accepted holds such a stretch.
MASKS = ("11101011", "11001000111", "101000100111", "111111")
# Likewise for items of 5 to 12 words as a whole, a fifth of whose words may be replaced.
SHORT_MASKS, SHORT_FROM = ("1111", "10111", "11011", "11101"), 5
#: An overlap has at least this many words (or the whole item, if that is shorter), and this share of equal words.
LEAST_WORDS, SHARE = 13, 0.8
#: Items of fewer words than this are not searched: they are no evidence.
SHORTEST_ITEM = 3
LARGEST_BITMAP = 27
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’–—…¿¡·"
#: Bytes of text in one round of array work; words a task remembers. A round's arrays take some 20 times its bytes.
ROUND, REMEMBERED = 1 << 19, 100_000


class WordHashes(dict):
    """What stands between white space → 64-bit hash of its lower-case form without outer signs; 0 if nothing is left."""

    def __missing__(self, chunk):
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        word = chunk.strip(SIGNS).lower()
        value = self[chunk] = (xxhash.xxh64_intdigest(word) or 1) if word else 0
        return value


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    """The words of one text; white space is ASCII white space, and chunks of signs alone are no words."""
    chunks = text.encode("utf-8", "surrogatepass").split()
    hashes = np.fromiter((known[c.decode("utf-8", "surrogatepass")] for c in chunks), np.uint64, len(chunks))
    return hashes[hashes != 0]


def batch_hashes(texts_, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of all words in an Arrow array of texts; equals ``word_hashes`` row by row."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts_)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(known.__getitem__, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return hashes[hashes != 0], rows[hashes != 0]


def seeds_of(words: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """For each mask the seed at each position, as signed 64-bit numbers."""
    made = []
    for number, mask in enumerate(masks):
        count = len(words) - len(mask) + 1
        if count <= 0:
            made.append(np.zeros(0, np.int64))
            continue
        value = np.full(count, 0x9E3779B97F4A7C15 * (number + 1) % 2**64, np.uint64)
        for at, bit in enumerate(mask):
            if bit == "1":
                value = (value ^ words[at:at + count]) * np.uint64(0xBF58476D1CE4E5B9)
                value ^= value >> np.uint64(29)
        made.append(value.view(np.int64))
    return made


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """(start, length) of the longest stretch with at least ``share`` of equal words, by one two-pointer walk."""
    if not len(equal):
        return 0, 0
    sums = np.concatenate([np.zeros(1), np.cumsum(np.where(equal, 1 - share, -share))]) + 1e-9 * np.arange(len(equal) + 1)
    low, high = np.minimum.accumulate(sums), np.maximum.accumulate(sums[::-1])[::-1]
    best, i, j = (0, 0), 0, 0
    while j < len(sums):
        if high[j] >= low[i]:
            if j - i > best[1]:
                best = (i, j - i)
            j += 1
        else:
            i += 1
    return best


def masks_hitting(length: int, least_words: int, share: float) -> tuple[str, ...]:
    """Masks of which one hits each accepted overlap with an item of so many words."""
    if share >= SHARE and length >= least_words >= LEAST_WORDS:
        return MASKS
    if share >= SHARE and SHORT_FROM <= length < min(least_words, LEAST_WORDS):
        return SHORT_MASKS
    if share >= SHARE and LEAST_WORDS <= length < least_words:
        return MASKS
    # An accepted stretch of twice the least length holds a shorter one; so many replaced words leave a run this long.
    stretches = range(least_words, 2 * least_words) if length >= least_words else [length]
    equal = {n: max(1, math.ceil(share * n - 1e-9)) for n in stretches}
    return ("1" * min(math.ceil(same / (n - same + 1)) for n, same in equal.items()),)


def masks_for(items: DataFrame, least_words: int = LEAST_WORDS, share: float = SHARE) -> dict[str, set[int]]:
    """Each mask with the lengths of the items that need it, from ``least_words`` on as one length."""
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        known = WordHashes()
        for frame in frames:
            yield pd.DataFrame({"n": [min(len(word_hashes(text, known)), least_words) for text in frame["text"]]})

    lengths = items.select("text").mapInPandas(run, "n int").filter(F.col("n") >= min(SHORTEST_ITEM, least_words))
    masks: dict[str, set[int]] = {}
    for row in lengths.distinct().orderBy("n").collect():
        for mask in masks_hitting(row.n, least_words, share):
            masks.setdefault(mask, set()).add(row.n)
    return masks


def benchmark_seeds(items: DataFrame, masks: dict[str, set[int]], least_words: int = LEAST_WORDS) -> DataFrame:
    """(seed, item_id, at) over all items."""
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        known = WordHashes()
        for frame in frames:
            for item_id, text in zip(frame["item_id"], frame["text"], strict=True):
                words = word_hashes(text, known)
                for lengths, seeds in zip(masks.values(), seeds_of(words, tuple(masks)), strict=True):
                    if min(len(words), least_words) in lengths:
                        yield pd.DataFrame({"seed": seeds, "item_id": item_id, "at": np.arange(len(seeds), dtype=np.int32)})

    return items.mapInPandas(run, "seed long, item_id long, at int")


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """A bitmap of about 16 bits per benchmark seed, of 128 KB to 16 MB, gathered with one row per byte."""
    count = seeds.count()
    power = min(LARGEST_BITMAP, max(20, (16 * count).bit_length()))
    place = F.col("seed").bitwiseAND(F.lit(2**power - 1))
    rows = (seeds.groupBy(F.shiftright(place, 3).cast("int").alias("byte"))
            .agg(F.bit_or(F.expr(f"shiftleft(1, cast((seed & {7}) as int))")).cast("short").alias("bits")).toPandas())
    bitmap = np.zeros(2**(power - 3), np.uint8)
    bitmap[rows["byte"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
    return bitmap


def document_hits(docs: DataFrame, bitmap: np.ndarray, masks: tuple[str, ...]) -> DataFrame:
    """(seed, doc_id, pos): the documents' seeds that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    lowest = len(bitmap) * 8 - 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known, bits = WordHashes(), shared.value
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            edges = np.flatnonzero(np.diff(sizes // ROUND, prepend=-1))
            for begin, stop in zip(edges, np.append(edges[1:], len(sizes)), strict=True):
                words, rows = batch_hashes(batch.column("text").slice(begin, stop - begin), known)
                ids = batch.column("doc_id").slice(begin, stop - begin).to_numpy(zero_copy_only=False)
                first = np.searchsorted(rows, np.arange(stop - begin))
                for mask, seeds in zip(masks, seeds_of(words, masks), strict=True):
                    place = seeds & lowest
                    at = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                    at = at[rows[at] == rows[at + len(mask) - 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seeds[at]), pa.array(ids[rows[at]], pa.int64()), pa.array((at - first[rows[at]]).astype(np.int32))],
                        names=["seed", "doc_id", "pos"])

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, "seed long, doc_id long, pos int")


SPANS = "doc_id long, spans array<struct<item_id:long,start:int,length:int,matched:int>>"


def overlaps(docs: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, share: float = SHARE) -> DataFrame:
    """(doc_id, spans) of the documents that hold a verified overlap with an item."""
    docs, items = texts(docs), items.select(F.col("item_id").cast("long").alias("item_id"),
                                            F.coalesce(F.col("text"), F.lit("")).alias("text"))
    masks = masks_for(items, least_words, share)
    seeds = settled(benchmark_seeds(items, masks, least_words))
    hits = document_hits(docs, seed_bitmap(seeds), tuple(masks))
    candidates = settled(hits.join(broadcast_if_small(seeds), "seed")
                         .groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("n")))
    per_doc = (candidates.join(items.withColumnRenamed("text", "item_text"), "item_id")
               .groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "item_text")).alias("found")))

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        known = WordHashes()
        for frame in frames:
            rows = []
            for doc_id, text, found in zip(frame["doc_id"], frame["text"], frame["found"], strict=True):
                words, spans = word_hashes(text, known), []
                for one in found:
                    item, diagonal = word_hashes(one["item_text"], known), one["diagonal"]
                    low, high = max(0, -diagonal), min(len(item), len(words) - diagonal)
                    equal = words[low + diagonal:high + diagonal] == item[low:high]
                    start, length = longest_stretch(equal, share)
                    if length >= min(least_words, len(item)) > 0:
                        spans.append((one["item_id"], low + diagonal + start, length, int(equal[start:start + length].sum())))
                if spans:
                    rows.append((doc_id, [dict(zip(("item_id", "start", "length", "matched"), s, strict=True)) for s in sorted(spans)]))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "spans"])

    return docs.join(broadcast_if_small(settled(per_doc), 20_000), "doc_id").mapInPandas(run, SPANS)


def mark(docs: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, spans (word positions).

    A null or empty text is clean, and so is everything if there are no items; a
    row with a null doc_id is never joined and counts as clean. Rows that repeat a
    doc_id share one verdict. Further columns are ignored.
    """
    found = settled(overlaps(docs, items, least_words, share)).dropDuplicates(["doc_id"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left").select(
        "doc_id", F.col("spans").isNotNull().alias("contaminated"),
        F.coalesce(F.array_distinct("spans.item_id"), F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<item_id:long,start:int,length:int,matched:int>>")).alias("spans"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, with all their columns."""
    found = settled(overlaps(docs, items).select("doc_id").distinct())
    return docs.join(broadcast_if_small(found), "doc_id", "left_anti").select(docs.columns)


def op5_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return mark(docs, items)
