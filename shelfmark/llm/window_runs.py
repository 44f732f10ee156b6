"""Windows of a fixed length that stand in more than one place, found without shipping every window.

Each window of ``window`` symbols is named by the smallest hash among its grams of
``gram`` symbols (its anchor), so equal windows have equal anchors. Successive
windows that share an anchor position are one run; a run is one entry (anchor
hash, content hash, document, start) instead of one row per window. Three steps use it:

1. ``entries``: tasks cut their texts into runs, settle runs that are equal within the
   task (all but one of them are known to be covered) and pack the rest into one
   block per shard of anchors, so that a hot run sends at most one entry per task.
2. ``settle``: each shard sorts its entries. Equal runs settle each other. Where one
   anchor has several different runs, one run of each content is asked for.
3. ``contents``: the documents hand over the content of the runs that were asked for, again
   by shard of anchors, where an index (suffix array, FM-index) finds the windows
   that different runs share.

A run is (start, first window to last window) with ``at`` = its anchor position.
All windows of a run hold its anchor, and equal windows hold it at the same offset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Symbols in one round of array work, and entries a task packs at a time.
ROUND, ENTRIES = 1 << 18, 500_000
PACKED = "shard int, kind int, block binary"
COVER, ASK = 0, 1
FOUND = "kind int, doc_id long, start int, at int, stop int, shard int"


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, count):
        if len(self.up) < count:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(max(count, 1 << 16), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    out, reach = values, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[:len(values) - width + 1], out[width - reach:][:len(values) - width + 1]) if reach < width else out


def runs_of(symbols: np.ndarray, window: int, gram: int, powers: Powers):
    """(anchor hash, content hash, start, at, stop) of one text's runs; content is symbols[start:stop]."""
    count = len(symbols)
    up, down = powers.get(count + 1)
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(symbols * up[:count], out=sums[1:])
    width = window - gram + 1
    grams = mixed((sums[gram:] - sums[:count - gram + 1]) * down[:count - gram + 1])
    least = sliding_minimum(grams, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    starts, ats, ends = [], [], []
    while len(first):
        near = grams[np.minimum(first[:, None] + np.arange(width)[None], len(grams) - 1)] == least[first][:, None]
        at = first + near.argmax(axis=1)
        end = np.minimum(last, at)
        starts.append(first)
        ats.append(at)
        ends.append(end)
        # Windows beyond the first place of the least gram hold a later, equal one.
        left = end < last
        first, last = end[left] + 1, last[left]
    starts, ats, ends = (np.concatenate(x) for x in (starts, ats, ends))
    stops = ends + window
    content = mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    + (ats - starts).astype(np.uint64))
    return least[starts], content, starts, ats, stops


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, sorted and disjoint; touching ones become one."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    opens = np.concatenate([[True], starts[1:] > stops[:-1]])
    return starts[opens], np.append(stops[:-1][opens[1:]], stops[-1])


_FIELDS = (("anchor", np.uint32), ("content", np.uint64), ("doc", np.int64), ("start", np.int32), ("at", np.uint8),
           ("length", np.int32), ("many", np.uint8))


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns as planes of bytes, sorted by document and with differences of doc_ids: what is nearly constant
    then lies together and all but vanishes in the shuffle's compression."""
    order = np.lexsort((columns[3], columns[2]))
    columns = [c[order] for c in columns]
    columns[2] = np.diff(columns[2], prepend=0)
    return b"".join(np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(len(c), -1).T.tobytes()
                    for c, (_, t) in zip(columns, _FIELDS, strict=True))


def _unpack(blocks: list[bytes]) -> list[np.ndarray]:
    size = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    parts = [[] for _ in _FIELDS]
    for block in blocks:
        count, at = len(block) // size, 0
        for n, (_, kind) in enumerate(_FIELDS):
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(block, np.uint8, count * width, at).reshape(width, count)
            values = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
            parts[n].append(np.cumsum(values) if n == 2 else values)
            at += count * width
    return [np.concatenate(p) for p in parts]


def _settled(anchor, content, doc, start, many, smaller_wins: bool):
    """Sort entries and settle equal runs: (order, stands, times, covered).

    stands: the entries that go on for their content; times: how often it was seen, 2 at most.

    smaller_wins: a run is covered if its content stands in a document with a smaller id; else if it stands anywhere else.
    """
    order = np.lexsort((start, doc, content, anchor))
    a, c, d, m = anchor[order], content[order], doc[order], many[order]
    opens = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    group = np.cumsum(opens) - 1
    if smaller_wins:
        # Repeats within the document that comes first share its fate, so all of them go on.
        stands, covered = d == d[opens][group], d > d[opens][group]
    else:
        stands, covered = opens, np.bincount(group, weights=m)[group] >= 2
    return order, stands, np.minimum(np.bincount(group, weights=m), 2)[group], covered


def entries(docs: DataFrame, symbols_of: Callable, state: Callable, hashes: Callable, window: int, gram: int, shards: int,
            smaller_wins: bool) -> DataFrame:
    """(shard, kind, block): packed entries, and intervals that are settled within a task.

    ``symbols_of(text, state())`` gives a text's symbols, ``hashes`` their 64-bit hashes. Rows with a null doc_id are left out.
    """
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        powers, held, total, known = Powers(), [], 0, state()

        def flush():
            anchor, content, doc, start, at, stop = (np.concatenate(c) for c in zip(*held, strict=True))
            many = np.ones(len(anchor), np.int64)
            order, stands, times, covered = _settled(anchor, content, doc, start, many, smaller_wins)
            rows = []
            if covered.any():
                d, s, e = (x[order][covered] for x in (doc, start, stop))
                by = np.argsort(d, kind="stable")
                d, s, e = d[by], s[by], e[by]
                edges = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]]))
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    ms, me = merged(s[low:high], e[low:high])
                    rows.append((int(d[low]) % shards, COVER, np.int64([d[low]]).tobytes() + np.stack([ms, me]).astype(np.int64).tobytes()))
            pick, sizes = order[stands], times[stands]
            shard = (anchor[pick] % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            pick, sizes, shard = pick[by], sizes[by], shard[by]
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                p = pick[low:high]
                # Within a shard 32 bits of the anchor are enough: runs that share them by chance only meet in vain.
                rows.append((int(shard[low]), ASK, _pack([anchor[p] // np.uint64(shards) & np.uint64(0xFFFFFFFF), content[p], doc[p], start[p],
                                                          at[p] - start[p], stop[p] - start[p], sizes[low:high]])))
            held.clear()
            return pd.DataFrame(rows, columns=["shard", "kind", "block"])

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                if doc_id != doc_id or doc_id is None:
                    continue
                symbols = symbols_of(text, known)
                # Very long texts go in blocks that share window - 1 symbols; each window lies in one block.
                for begin in range(0, max(0, len(symbols) - window + 1), ROUND):
                    anchor, content, start, at, stop = runs_of(hashes(symbols[begin:begin + ROUND + window - 1]), window, gram, powers)
                    held.append((anchor, content, np.full(len(anchor), doc_id, np.int64), start + begin, at + begin, stop + begin))
                    total += len(anchor)
                if total >= ENTRIES:
                    total = 0
                    yield flush()
        if held:
            yield flush()

    return docs.mapInPandas(run, PACKED)


def settle(packed: DataFrame, smaller_wins: bool) -> DataFrame:
    """Per shard: intervals known to be covered (kind COVER) and runs whose content is asked for (kind ASK)."""
    def run(frame):
        import pandas as pd

        parts, shard = [[] for _ in range(5)], int(frame["shard"].iloc[0])
        for block in frame.loc[frame["kind"] == COVER, "block"]:
            values = np.frombuffer(block, np.int64)
            starts, stops = values[1:].reshape(2, -1)
            zero = np.zeros(len(starts), np.int64)
            for part, column in zip(parts, (zero + COVER, zero + values[0], starts, zero, stops), strict=True):
                part.append(column)
        blocks = list(frame.loc[frame["kind"] == ASK, "block"])
        if blocks:
            anchor, content, doc, start, at, length, many = _unpack(blocks)
            order, stands, _, covered = _settled(anchor, content, doc, start, many.astype(np.int64), smaller_wins)
            a, c = anchor[order], content[order]
            fresh = np.concatenate([[True], a[1:] != a[:-1]])
            differs = fresh | np.concatenate([[True], c[1:] != c[:-1]])
            group = np.cumsum(fresh) - 1
            ask = stands & (np.bincount(group, weights=differs)[group] > 1)
            if not smaller_wins:
                covered &= many[order] < 2  # else its own task has said so
            for kind, chosen in ((COVER, covered), (ASK, ask)):
                rows = order[chosen]
                first = start[rows].astype(np.int64)
                for part, column in zip(parts, (np.full(len(rows), kind), doc[rows], first, first + at[rows], first + length[rows]), strict=True):
                    part.append(column)
        kind, doc_id, start, at, stop = (np.concatenate(p) for p in parts)
        return pd.DataFrame({"kind": kind.astype(np.int32), "doc_id": doc_id, "start": start.astype(np.int32), "at": at.astype(np.int32),
                             "stop": stop.astype(np.int32), "shard": np.full(len(kind), shard, np.int32)})

    return packed.groupBy("shard").applyInPandas(run, FOUND)


def contents(docs: DataFrame, found: DataFrame, symbols_of: Callable, state: Callable) -> DataFrame:
    """(shard, doc_id, start, at, stop, content): the runs asked for, with their content as bytes."""
    # Lists of one aggregation keep one order; a list is as long as its document at most.
    asked = found.filter(F.col("kind") == ASK).groupBy("doc_id").agg(
        *[F.collect_list(name).alias(name) for name in ("start", "at", "stop", "shard")])

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        known = state()
        for frame in frames:
            rows = []
            for doc_id, text, start, at, stop, shard in zip(*(frame[c] for c in frame.columns), strict=True):
                symbols = symbols_of(text, known)
                for one in zip(shard.tolist(), start.tolist(), at.tolist(), stop.tolist(), strict=True):
                    rows.append((one[0], doc_id, *one[1:], symbols[one[1]:one[3]].tobytes()))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["shard", "doc_id", "start", "at", "stop", "content"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["shard", "doc_id", "start", "at", "stop", "content"])

    return docs.join(asked, "doc_id").select("doc_id", "text", "start", "at", "stop", "shard").mapInPandas(
        run, "shard int, doc_id long, start int, at int, stop int, content binary")


def covered_texts(docs: DataFrame, found: DataFrame, more: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Hand every document's text with its merged covered intervals to ``finish``."""
    spans = (found.filter(F.col("kind") == COVER).select("doc_id", "start", "stop").unionByName(more)
             .groupBy("doc_id").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop")))

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for doc_id, text, starts, stops in zip(*(frame[c] for c in frame.columns), strict=True):
                if starts is None:
                    starts = stops = np.zeros(0, np.int64)
                else:
                    starts, stops = merged(starts, stops)
                rows.append(finish(doc_id, text, starts, stops))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "start", "stop").mapInPandas(run, schema)
