import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from shelfmark.llm import periodic_runs as runs

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_runs(words, least=6, exponent=4):
    """All runs by their definition: every period, every maximal stretch, smallest period only."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            stop = at
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            if stop + q - at >= max(least, exponent * q):
                found.setdefault((at, stop + q), q)
            at = stop
    return sorted((start, stop - start, q) for (start, stop), q in found.items())


def brute_row(doc_id, text):
    words = SPLIT.findall((text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]
    found = brute_runs(words)
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    kept = b" ".join(word for i, word in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def some_texts():
    rng = random.Random(5)
    out = [None, "", "  \n", "a", "a a a a a", "a a a a a a", "A a a a a a a", "a b " * 4, "a b a b a b a b a b a b", "x " * 5000]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.choice("abcdé") for _ in range(rng.randint(1, 9))]
            parts += unit * rng.randint(1, 7) + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
        out.append(rng.choice([" ", "\t", " \n"]).join(parts))
    long = [f"w{rng.randint(0, 400)}" for _ in range(700)]
    out += [" ".join(long * 5 + long[:30]), " ".join(long[:100] * 3 + ["odd"] + long[:100] * 9)]
    return out


def test_query_equals_brute_force(spark):
    rows = list(enumerate(some_texts() * 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as words", "2 as runs").repartition(5)
    got = runs.op11_periodic_runs(docs)
    assert {tuple(r) for r in got.collect()} == {brute_row(*row) for row in rows}
    assert any(zlib.crc32(str(n).encode()) % 10 == 0 for n, _ in rows)


def test_query_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {tuple(r) for r in runs.op11_periodic_runs(docs).collect()} == {brute_row(r.doc_id, r.text) for r in docs.collect()}


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (4, 3)])
def test_runs_of_short_alphabets(least, exponent):
    rng = random.Random(least)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(80)]
    texts += [list("a" * 50), list("ab" * 30 + "a"), list("aabaabaab" * 5 + "aab" * 6)]
    texts.sort(key=len, reverse=True)
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.array([2 * n + (letter == "b") for n, t in enumerate(texts) for letter in t], np.int64)
    begins = np.cumsum(sizes) - sizes
    got = sorted(zip(*(x.tolist() for x in runs.find_runs(words, sizes, least, exponent)), strict=True))
    assert got == sorted((begins[n] + s, begins[n] + s + length, q) for n, t in enumerate(texts) for s, length, q in brute_runs(t, least, exponent))


def test_extension_queries():
    rng = random.Random(3)
    words = np.array([rng.choice([0, 0, 1, 2]) for _ in range(400)] * 3 + [1] * 300 + [0, 1] * 200, np.int64)
    grammar = runs.Grammar(words)
    one = np.array([rng.randrange(len(words) - 1) for _ in range(3000)])
    two = np.array([rng.randrange(a + 1, len(words)) for a in one])
    for forward in (True, False):
        got = grammar.extension(one, two, forward)
        for a, b, n in zip(one, two, got, strict=True):
            step = 0
            while (b + step < len(words) if forward else step < a) and words[a + step if forward else a - 1 - step] == words[b + step if forward else b - 1 - step]:
                step += 1
            assert n == step


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a a a a a a a"), (10, "a a a a a a a"), (10, "b"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in runs.periodic_runs(docs).collect())
    assert got == [(0, 0, "", []), (0, 7, "a", [(0, 7, 1)]), (10, 1, "b", []), (10, 7, "a", [(0, 7, 1)])]
    assert runs.op11_periodic_runs(docs).filter("doc_id is null and n_runs = 1").count() == 1
    assert runs.op11_periodic_runs(docs.limit(0)).count() == 0
