"""Suffix-array and FM-index deduplication against brute force, on texts made to be awkward."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import substring_dedup, suffix_dedup, window_runs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array_equals_sorted_suffixes(values):
    assert suffix_dedup.suffix_array(np.array(values)).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=20, max_size=200))
def test_each_window_lies_in_one_run_and_equal_windows_share_anchor_and_offset(values):
    window, gram = 12, 4
    symbols = window_runs.mixed(np.array(values, np.uint64) + np.uint64(7))
    anchor, _, start, at, stop = window_runs.runs_of(symbols, window, gram, window_runs.Powers())
    seen, named = set(), {}
    for a, s, p, e in zip(anchor.tolist(), start.tolist(), at.tolist(), stop.tolist(), strict=True):
        for w in range(s, e - window + 1):
            assert w not in seen and w <= p <= w + window - gram
            seen.add(w)
            assert named.setdefault(tuple(values[w:w + window]), (a, p - w)) == (a, p - w)
    assert seen == set(range(len(values) - window + 1))


def awkward():
    rng = random.Random(3)
    words = ["ab", "cd", "é", "xyz", "the", "of", "\x00q"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 220))) for _ in range(60)]
    shared = " ".join(f"w{n}" for n in range(60))
    hot = [f"{n} " + shared + f" {n}" for n in range(40)] + [shared] * 40
    texts = prose + hot + prose[:20] + [None, "", "a" * 400, "a" * 130, "ab" * 90, shared + " " + shared, " \t\n" * 30,
                                        prose[3] + prose[4], "z" * 49, "y" * 50, "y" * 50]
    return [(n * 3 + 1, text) for n, text in enumerate(texts)]


def expected_bytes(rows, window):
    first = {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1):
            first.setdefault(raw[i:i + window], doc)
    out = {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if first[raw[i:i + window]] < doc:
                gone[i:i + window] = b"\1" * window
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def expected_words(rows, window):
    count = {}
    split = {doc: (text or "").encode().split() for doc, text in rows}
    for words in split.values():
        for i in range(len(words) - window + 1):
            count[tuple(words[i:i + window])] = count.get(tuple(words[i:i + window]), 0) + 1
    out = {}
    for doc, words in split.items():
        gone = bytearray(len(words))
        for i in range(len(words) - window + 1):
            if count[tuple(words[i:i + window])] > 1:
                gone[i:i + window] = b"\1" * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as kind", "1 as start", "2 as stop").repartition(5)
    monkeypatch.setattr(window_runs, "ENTRIES", 500)
    monkeypatch.setattr(window_runs, "ROUND", 100)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.mark(docs).collect()}
    assert got == expected_bytes(rows, 50)


def test_substring_dedup_equals_brute_force(spark, monkeypatch):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as kind", "1 as start", "2 as stop").repartition(5)
    monkeypatch.setattr(window_runs, "ENTRIES", 100)
    monkeypatch.setattr(window_runs, "ROUND", 50)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.mark(docs).collect()}
    assert got == expected_words(rows, 35)


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "x" * 60), (4, "x" * 60)], "doc_id long, text string")
    for module in (suffix_dedup, substring_dedup):
        assert module.mark(docs.limit(0)).count() == 0
        assert sorted((r.doc_id or -1, r.n_removed) for r in module.mark(docs).collect()) == [(-1, 0), (4, 0)]


def test_wavelet_ranks_and_backward_search():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 9, 1000)
    matrix = substring_dedup.WaveletMatrix(values, 9)
    for symbol in range(9):
        base = matrix.places(np.array([symbol]), np.array([0]))
        for end in (0, 1, 63, 64, 65, 500, 1000):
            assert (matrix.places(np.array([symbol]), np.array([end])) - base)[0] == (values[:end] == symbol).sum()
    runs = [rng.integers(0, 3, rng.integers(5, 30)).astype(np.uint64) for _ in range(40)]
    index = substring_dedup.Index(runs)
    flat = [tuple(r.tolist()) for r in runs]
    for run, begin in zip(flat, index.starts.tolist(), strict=True):
        got = index.statistics(np.arange(begin + 4, begin + len(run)), 5)
        for end, statistic in enumerate(got.tolist(), 4):
            times = lambda length: sum(r[i:i + length] == run[end + 1 - length:end + 1] for r in flat for i in range(len(r) - length + 1))  # noqa: E731, B023
            assert statistic == max((n for n in range(1, 6) if times(n) > 1), default=0)
