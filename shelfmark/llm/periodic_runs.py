"""Periodic runs of words, found with a run-length grammar made by recompression.

A run is a stretch of words with smallest period q, as long as the least length asks for,
that no neighbouring word extends. Documents are independent, so tasks work through
their own rows, many documents at a time in one concatenated array of word numbers
(numbers differ between documents, so nothing ever matches across their edges):

1. Recompression. Levels alternate: block compression makes each maximal repetition of one symbol a
   symbol (symbol, times), pair compression splits the symbols into left and right ones
   by a hash and makes each (left, right) a symbol. A symbol is the same wherever its words are
   the same and its surroundings leave it alone, so equal stretches get equal symbols but at
   their edges. A symbol that stands only once matches nothing and is not compressed further, so
   ordinary texts have few levels and few symbols.
2. Extension queries. Each place knows the symbols of all levels that start (and end) there. Two places
   are compared by the largest symbols that both have, whole repetitions at once: up through the
   levels and down again, in logarithmically many steps, all queries in step with each other.
3. Harmonic grid. The stretch where words q apart agree is as long as the least length less q. Places
   at that spacing therefore hit every run of period q; all periods together need n log n places.
   Where the words at a place and q later agree, two queries give the exact ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES

#: A run is this many words long at least, and this many times its period.
LEAST, EXPONENT = 6, 4
#: Words taken together in one round of array work (a longer document is a round of its own), and grid places compared at a time.
ROUND, PLACES = 1 << 18, 1 << 18


class Grammar:
    """Run-length grammar over word numbers, with extension queries in both directions."""

    def __init__(self, words: np.ndarray):
        count = len(words)
        levels = []
        at, symbol, size = np.arange(count), words.astype(np.int64), np.ones(count, np.int64)
        while True:
            at, symbol, size = self._repeated(at, symbol, size)
            if not len(at):
                break
            joined = at[1:] == at[:-1] + size[:-1]
            same = joined & (symbol[1:] == symbol[:-1])
            opens = np.flatnonzero(np.concatenate([[True], ~same]))
            times = np.diff(np.append(opens, len(at)))
            within = np.arange(len(at)) - np.repeat(opens, times)
            levels.append((at, symbol, size, np.repeat(times, times) - within, within + 1))
            # Blocks: a symbol and how often it stands in a row.
            at, size = at[opens], size[opens] * times
            symbol = symbol[opens] * (int(times.max()) + 1) + times
            at, symbol, size = self._repeated(at, symbol, size)
            if not len(at):
                break
            once = np.ones(len(at), np.int64)
            levels.append((at, symbol, size, once, once))
            joined = at[1:] == at[:-1] + size[:-1]
            if not joined.any():
                break
            # Pairs: left symbols with the right symbol that follows.
            left = self._sides(symbol, len(levels))
            paired = np.append(joined & left[:-1] & ~left[1:], False)
            second = np.concatenate([[False], paired[:-1]])
            follower = np.where(paired, np.append(symbol[1:], 0) + 1, 0)
            symbol = (symbol * (int(symbol.max()) + 2) + follower)[~second]
            size = (size + np.where(paired, np.append(size[1:], 0), 0))[~second]
            at = at[~second]
        self.forward = self._by_place(count, [(at, symbol, size, ahead) for at, symbol, size, ahead, _ in levels])
        self.backward = self._by_place(count, [(at + size, symbol, size, behind) for at, symbol, size, _, behind in levels])

    @staticmethod
    def _repeated(at, symbol, size):
        """Symbols numbered anew from 0, without those that stand only once."""
        if not len(at):
            return at, symbol, size
        order = np.argsort(symbol, kind="stable")
        ordered = symbol[order]
        opens = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(opens) - 1
        keep = np.bincount(number)[number] > 1
        return at[keep], number[keep], size[keep]

    @staticmethod
    def _sides(symbol, level):
        mixed = (symbol.astype(np.uint64) + np.uint64(level * 0x9E3779B9 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (mixed >> np.uint64(63)).astype(bool)

    @staticmethod
    def _by_place(count, levels):
        """(first entry of each place, symbol, size, times): a place's symbols lie together, lowest level first."""
        depth = np.zeros(count + 2, np.int64)
        for place, *_ in levels:
            depth[place + 1] += 1
        first = np.cumsum(depth)
        total = int(first[-1])
        symbol, size, times = np.zeros(total + 1, np.int32), np.zeros(total + 1, np.int32), np.zeros(total + 1, np.int32)
        for level, (place, symbols, sizes, repeats) in enumerate(levels):
            entry = first[place] + level
            symbol[entry], size[entry], times[entry] = symbols, sizes, repeats
        return first, symbol, size, times

    def extension(self, one: np.ndarray, two: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from (or, backwards, before) the places ``one`` and ``two`` agree."""
        first, symbol, size, times = self.forward if forward else self.backward
        out = np.zeros(len(one), np.int64)
        alive, level = np.arange(len(one)), np.zeros(len(one), np.int64)
        a, b = one.copy(), two.copy()
        while len(alive):
            p, q = first[a] + level, first[b] + level
            same = (p < first[a + 1]) & (q < first[b + 1]) & (symbol[np.minimum(p, len(symbol) - 1)] == symbol[np.minimum(q, len(symbol) - 1)])
            step = np.zeros(len(alive), np.int64)
            p, q = p[same], q[same]
            step[same] = np.minimum(times[p], times[q]).astype(np.int64) * size[p]
            out[alive] += step
            a, b = (a + step, b + step) if forward else (a - step, b - step)
            level += np.where(same, 1, -1)
            keep = level >= 0
            if not keep.all():
                alive, level, a, b = alive[keep], level[keep], a[keep], b[keep]
        return out


def grid(words: np.ndarray, sizes: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of grid places whose word stands again a period later. ``sizes``: words of each document, longest first."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    longest = int(sizes[0]) if len(sizes) else 0
    places, periods, held = [], [], 0
    for period in range(1, longest // exponent + 1):
        length = max(least, exponent * period)
        reach = int(ends[np.searchsorted(-sizes, -length, side="right")])
        if reach <= period:
            break
        step = length - period
        hit = np.flatnonzero(words[:reach - period:step] == words[period:reach:step]) * step
        if len(hit):
            places.append(hit)
            periods.append(np.full(len(hit), period))
            held += len(hit)
        if held >= PLACES:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(start, stop, period) of all runs in concatenated documents, sorted by start and period.

    ``words``: numbers that differ between documents; ``sizes``: words of each document, longest first.
    """
    grammar, found = None, []
    for place, period in grid(words, sizes, least, exponent):
        grammar = grammar or Grammar(words)
        stop = place + period + grammar.extension(place, place + period, True)
        start = place - grammar.extension(place, place + period, False)
        keep = stop - start >= np.maximum(least, exponent * period)
        found.append(np.stack([start[keep], stop[keep], period[keep]]))
    if not found:
        return tuple(np.zeros((3, 0), np.int64))
    start, stop, period = np.concatenate(found, axis=1)
    # A multiple of a period has the same stretch; the smallest period names the run.
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    fresh = np.concatenate([[True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])]) if len(start) else np.zeros(0, bool)
    start, stop, period = start[fresh], stop[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


class _Numbers(dict):
    def __missing__(self, word):
        value = self[word] = len(self)
        return value


def _round(texts: list[list[bytes]], least: int, exponent: int):
    """(document, start, length, period) of a round's runs, and the kept words of the documents that have runs."""
    order = sorted(range(len(texts)), key=lambda n: -len(texts[n]))
    sizes = np.array([len(texts[n]) for n in order], np.int64)
    number = _Numbers()
    codes = np.fromiter((number[word] for n in order for word in texts[n]), np.int64, int(sizes.sum()))
    document = np.repeat(np.arange(len(order)), sizes)
    start, stop, period = find_runs(document * max(1, len(number)) + codes, sizes, least, exponent)
    begins = np.cumsum(sizes) - sizes
    of = document[start]
    gone = np.zeros(len(codes) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, stop, -1)
    stays = np.cumsum(gone)[:-1] == 0
    kept = {}
    for n in np.unique(of).tolist():
        words, flags = texts[order[n]], stays[begins[n]:begins[n] + sizes[n]]
        kept[order[n]] = [words[at] for at in np.flatnonzero(flags).tolist()]
    return np.array(order, np.int64)[of], start - begins[of], stop - start, period, kept


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed.

    ``runs``: array of (start, length, period) in words, by start and period. ``collapsed``: the words that no run
    holds after its first period, joined by one space. A null text and an empty one have no words, no runs and
    an empty ``collapsed``. Rows are independent: repeated rows and ids, and rows with a null doc_id, each
    get their own result. No rows give no rows; further columns are ignored. A text of any length is
    taken whole; its task needs memory in proportion to its longest text.
    """
    import pyarrow as pa

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def part(ids, texts):
        document, start, length, period, kept = _round(texts, least, exponent)
        by = np.lexsort((period, start, document))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(document, minlength=len(texts)))])
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(column[by], pa.int64()) for column in (start, length, period)], fields=list(run_type)))
        collapsed = pa.array([b" ".join(kept.get(n, words)) for n, words in enumerate(texts)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), runs, collapsed],
                                          ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = text.as_py().split()
                if texts and held + len(words) > ROUND:
                    yield part(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
            if texts:
                yield part(ids, texts)

    found = plain.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the text of every document whose crc32(doc_id) is divisible by 10 made periodic from a place of its own.

    With h = crc32 of the decimal doc_id and g = floor(h / 10), each word i >= a becomes word a + (i - a) mod p, where
    a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)). Rows with a null doc_id or without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    words = F.filter(F.split("text", SPACES, -1), lambda word: word != "")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.expr("0L").alias("zero"), F.floor(h / 10).alias("g"))
    chosen = chosen.withColumn("n", F.size("words"))
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))

    def cut(array: Column, begin: Column, length: Column) -> Column:
        return F.slice(array, begin, length)

    rest = F.col("n") - F.col("a")
    repeated = F.flatten(F.array_repeat(cut(F.col("words"), F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    made = F.concat(cut(F.col("words"), F.lit(1), F.col("a")), cut(repeated, F.lit(1), rest))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", made)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    found = periodic_runs(with_planted_runs(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))))
    named = found.withColumn("best", best)
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
