"""Removal of repeated word sequences with a compressed FM-index per shard.

Windows of ``window`` words are gathered by anchor (see ``window_runs``). Each shard of
anchors indexes the runs that differ: the Burrows-Wheeler transform of their words
stands in a wavelet matrix of bit vectors with rank counts. The same runs are then
streamed through it by backward search, all windows at once; a window's matching
statistic is the number of its last words that stand in two or more places, and windows
whose statistic reaches the threshold (the whole window) are reported as intervals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import window_runs as runs
from shelfmark.llm.common import shards_for, stored

WINDOW, GRAM = 35, 8
#: Bytes of text for each shard of anchors.
SHARD_BYTES = 64 << 20
#: Windows in one round of backward search.
STREAM = 200_000
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class WaveletMatrix:
    """Rank of a symbol in a sequence over 0 .. symbols - 1: one packed bit vector per bit of a symbol."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bits = (values >> level) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]]))
            self.zeros.append(int(len(values) - bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def places(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the prefix ``[0, end)`` of each symbol ends in the last level; differences of places are ranks."""
        at = ends
        for n in range(self.depth):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[n][word] + np.bitwise_count(self.words[n][word] & mask)
            at = np.where((symbols >> (self.depth - 1 - n)) & 1, self.zeros[n] + ones, at - ones)
        return at


def suffix_order(values: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order by prefix doubling; symbols that end a run are unique, so ``longest`` symbols decide."""
    rank, reach = np.unique(values, return_inverse=True)[1].reshape(-1).astype(np.int64), 1
    count = len(values)
    while reach < longest:
        behind = np.zeros(count, np.int64)
        behind[:count - reach] = rank[reach:] + 1
        fresh = np.unique(rank * (count + 2) + behind, return_inverse=True)[1].reshape(-1)
        if fresh.max() == count - 1:
            rank = fresh
            break
        rank, reach = fresh, reach * 2
    return np.argsort(rank, kind="stable")


class Index:
    """FM-index over runs of word hashes."""

    def __init__(self, contents: list[np.ndarray]):
        sizes = np.array([len(c) for c in contents])
        self.alphabet, codes = np.unique(np.concatenate(contents), return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(int(sizes.sum() + len(sizes)), bool)
        inside[ends] = False
        # Ends come before all words, each one different, in the order of the runs.
        text = np.empty(len(inside), np.int64)
        text[inside] = codes.reshape(-1) + len(contents)
        text[~inside] = np.arange(len(contents))
        order = suffix_order(text, int(sizes.max()) + 1)
        self.codes = np.where(inside, text - len(contents) + 1, 0)
        self.wavelet = WaveletMatrix(self.codes[order - 1], len(self.alphabet) + 1)
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(self.alphabet) + 1))])
        every = np.arange(len(self.alphabet) + 1)
        self.first = self.wavelet.places(every, np.zeros(len(every), np.int64))
        self.starts = ends - sizes

    def statistics(self, ends: np.ndarray, window: int) -> np.ndarray:
        """For each end (a place in the indexed text) how many words up to it, ``window`` at most, stand in two places."""
        out = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        symbols = self.codes[ends]
        low, high = self.begins[symbols], self.begins[symbols + 1]
        for step in range(1, window + 1):
            keep = high - low >= 2
            alive, low, high = alive[keep], low[keep], high[keep]
            out[alive] = step
            if step == window or not len(alive):
                break
            symbols = self.codes[ends[alive] - step]
            base = self.begins[symbols] - self.first[symbols]
            low, high = base + self.wavelet.places(symbols, low), base + self.wavelet.places(symbols, high)
        return out


def shared_windows(contents: list[np.ndarray], window: int):
    """(run, first, stop): intervals of each run whose windows stand in another run too."""
    index = Index(contents)
    counts = np.array([len(c) for c in contents]) - window + 1
    run = np.repeat(np.arange(len(contents)), counts)
    within = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = index.starts[run] + within + window - 1
    statistics = np.concatenate([index.statistics(ends[at:at + STREAM], window) for at in range(0, len(ends), STREAM)])
    hit = np.flatnonzero(statistics >= window)
    if not len(hit):
        return hit, hit, hit
    breaks = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(run[hit]) != 0), [True]]))
    first, last = hit[breaks[:-1]], hit[breaks[1:] - 1]
    return run[first], within[first], within[last] + window


class WordHashes(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mark(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words that holds it also starts anywhere else,
    the same document included. Null and empty texts have no words and keep the digest
    of nothing; shorter texts stay whole. A row with a null doc_id neither loses nor
    takes words; of rows that repeat a doc_id each counts as a place of its own.
    Further columns are ignored.
    """
    from hashlib import sha256

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    shards = shards_for(plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, SHARD_BYTES)

    def symbols(text, known):
        words = text.split()
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    packed = runs.entries(plain, symbols, WordHashes, lambda values: values, window, gram, shards, False)
    found = stored(runs.settle(packed, False), "runs")

    def index(frame):
        import pandas as pd

        run, first, stop = shared_windows([np.frombuffer(c, np.uint64) for c in frame["content"]], window)
        start = frame["start"].to_numpy()[run]
        return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[run], "start": (start + first).astype(np.int32), "stop": (start + stop).astype(np.int32)})

    asked = runs.contents(plain, found, symbols, WordHashes)
    more = asked.groupBy("shard").applyInPandas(index, "doc_id long, start int, stop int")

    def finish(doc_id, text, starts, stops):
        words = text.split()
        kept, at = [], 0
        for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
            kept += words[at:start]
            at = stop
        kept += words[at:]
        return doc_id, len(words), len(words) - len(kept), sha256(b" ".join(kept)).hexdigest()

    return runs.covered_texts(plain, found, more, finish, RESULT)


def op9_substring_dedup(docs: DataFrame) -> DataFrame:
    return mark(docs)
