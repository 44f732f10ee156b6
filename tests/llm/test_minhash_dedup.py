import random

import numpy as np
import pytest

from shelfmark.llm import minhash_dedup as near
from shelfmark.llm.jaccard_join import WordHashes
from tests.llm.test_jaccard_join import brute, near_copies


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize(("words", "percent"), [(4, 80), (5, 85), (3, 90)])
def test_equals_brute_force(spark, words, percent):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L as sid", "2 as n", "'x' as keys").repartition(6)
    frame = near.components(docs, words, percent)
    want = brute(rows, words, percent)
    assert got(frame) == want
    assert {r.doc_id for r in frame.filter("kept").collect()} == {doc for doc, (_, root) in want.items() if doc == root}


def test_a_family_without_its_origin(spark, monkeypatch):
    """Many copies near the threshold, blocks of a few members: what hubs leave apart is found by comparison."""
    monkeypatch.setattr(near, "SIDE", 7)
    rng = random.Random(2)
    base, rows = [f"w{n}" for n in range(150)], []
    for doc in range(90):
        text = list(base)
        for _ in range(rng.randint(2, 6)):
            text[rng.randrange(len(text))] = f"x{rng.random()}"
        rows.append((doc, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 4, 80)
    assert len({root for _, root in want.values()}) > 1
    assert got(near.op13_minhash_dedup(docs)) == want


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(near.op13_minhash_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 80)


def test_estimates_are_within_their_error(spark):
    rng = random.Random(9)
    base = [f"w{n}" for n in range(800)]
    texts = [" ".join(base).encode()]
    for changes in (5, 20, 60):
        text = list(base)
        for _ in range(changes):
            text[rng.randrange(len(text))] = f"x{rng.random()}"
        texts.append(" ".join(text).encode())
    values, sizes = near.shingle_sets(texts, 4, WordHashes())
    sets = np.split(values, np.cumsum(sizes)[:-1])
    for count, bits in ((near.MINIMA, near.BITS), (near.MORE_MINIMA, near.MORE_BITS)):
        rows = near.packed(near.minima(values, sizes, count), bits)
        table = spark.createDataFrame([(rows[0].tolist(), row.tolist()) for row in rows], "one array<long>, two array<long>")
        chance = 2.0 ** -bits
        for n, row in enumerate(table.select(near.agreement("one", "two", count, bits).alias("agree")).collect()):
            true = len(np.intersect1d(sets[0], sets[n])) / len(np.union1d(sets[0], sets[n]))
            assert abs((row.agree / count - chance) / (1 - chance) - true) < 5 * (0.25 / count) ** 0.5 / (1 - chance)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text here now"), (9, "quite another text here now"),
                                  (None, "a b c d e f"), (7, None), (8, ""), (1, "a b c d e f")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near.components(docs).collect())
    assert rows == [(0, 3, 0, True), (1, 3, 1, True), (1, 3, 1, True), (5, 2, 5, True), (5, 3, 1, False), (7, 0, 7, True), (8, 0, 8, True), (9, 2, 5, False)]
    assert near.components(docs.limit(0)).count() == 0
