import random

import numpy as np
import pytest

from shelfmark.llm import jaccard_join


def brute(rows, words, percent):
    sets = {}
    for doc, text in rows:
        found = (text or "").encode().lower().split()
        sets[doc] = ({tuple(found[i:i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set())
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), root(doc)) for doc in docs}


def near_copies():
    rng = random.Random(11)
    out = [None, "", "one", "One", "a b c", "A  b\tc", "a b c d", "É a b c d", "é a b c d"]
    for family in range(12):
        base = [f"f{family}w{rng.randint(0, 900)}" for _ in range(rng.choice([6, 9, 15, 40, 120, 300]))]
        for _ in range(9):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                at = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text[at] = f"new{rng.random()}"
                else:
                    del text[at]
            out.append(" ".join(text))
        # a chain: each one near the next only
        text = list(base)
        for _ in range(6):
            text[rng.randrange(len(text))] = f"chain{rng.random()}"
            out.append(" ".join(text))
    out += out[20:40]
    return [(3 * n + 2, text) for n, text in enumerate(out)]


@pytest.mark.parametrize(("words", "percent", "thin"), [(4, 85, 1), (5, 80, 0), (3, 60, 2)])
def test_equals_brute_force(spark, words, percent, thin):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L as sid", "2 as n", "'x' as shard").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs, words, percent, thin).collect()}
    assert got == brute(rows, words, percent)


def test_partners_are_at_most_one_band_away():
    for percent in (60, 80, 85, 95):
        bounds = jaccard_join.bands(percent, 3000)
        band = lambda n: int((bounds <= n).sum()) - 1  # noqa: E731, B023
        assert all(band(n * 100 // percent) - band(n) <= 1 for n in range(1, 2000))


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 9), (2, "a b c d e f", 8), (3, None, 7), (None, "a b c d e f", 6)],
                                 "doc_id long, text string, component_id int")
    assert sorted(jaccard_join.keep_one(docs).collect(), key=str) == sorted(docs.filter("doc_id is null or doc_id <> 2").collect(), key=str)
    assert jaccard_join.components(docs.limit(0)).count() == 0


def test_a_repeated_id_with_another_text_loses_no_link(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (5, "quite another text that is here now"), (5, "a b c d e f g"), (9, "quite another text that is here now")],
                                 "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect())
    assert got == [(1, 4, 1), (5, 4, 1), (5, 4, 5), (9, 4, 5)]
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs, 4, 85).collect()) == [1, 5, 5]


@pytest.mark.parametrize("frequent", [0.0, 0.5, 1.0])
def test_linked_sets_share_a_signature_whatever_counts_as_frequent(frequent):
    """Exactness does not hang on the counts: any shingles may be held for frequent."""
    rng = np.random.default_rng(3)
    bounds, counts = jaccard_join.segment_counts(80)
    for trial in range(150):
        size = int(rng.integers(2, 120))
        one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        edits = int(rng.integers(0, max(1, size // 8) + 1))
        two = np.unique(np.concatenate([one[edits:], rng.integers(0, 2**63, int(rng.integers(0, edits + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(one, two))
        if 100 * shared < 80 * (len(one) + len(two) - shared):
            continue
        often = np.sort(rng.choice(np.union1d(one, two), int(frequent * len(np.union1d(one, two))), replace=False))
        found = []
        for members in (one, two):
            band = int(np.searchsorted(bounds, len(members), side="right")) - 1
            mine = set()
            for config in (band, band - 1):
                if config >= 0:
                    sig, _ = jaccard_join.signatures(members, np.array([len(members)]), np.array([config]), counts, 1, often)
                    mine |= set(sig.tolist())
            found.append(mine)
        assert found[0] & found[1], (trial, len(one), len(two), shared)


def test_large_groups_and_wrong_short_hashes(spark, monkeypatch):
    """Blocks of a few sets, and short hashes so few that unlike sets look alike: the same components."""
    rows = near_copies()
    want = brute(rows, 4, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "SIDE", 6)
    seen = []
    first = jaccard_join.overlap_links

    def doubtful(percent, short):
        seen.append(short)
        return first(percent - 25 if short else percent, short)

    monkeypatch.setattr(jaccard_join, "overlap_links", doubtful)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()}
    assert got == want and seen == [True, False]


def test_bitmaps_never_differ_in_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = int(rng.integers(1, 300))
        one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        two = np.unique(np.concatenate([one[int(rng.integers(0, len(one) + 1)):], rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64)]))
        a, b = jaccard_join.parities(one)[None], jaccard_join.parities(two)[None]
        words = min(a.shape[1], b.shape[1])
        assert 64 * a.shape[1] >= jaccard_join.SPARSE * len(one)
        assert np.bitwise_count(jaccard_join.folded(a, words) ^ jaccard_join.folded(b, words)).sum() <= len(np.setxor1d(one, two))


def test_sets_travel_as_bitmaps_of_less_than_a_byte_for_each_shingle(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first, sent = jaccard_join.crossing_links, []

    def seen(members, state, carry, links, *more):
        def weighed(sids):
            carried = carry(sids)
            sent.append(carried.selectExpr("sum(octet_length(block)) AS bytes").first().bytes)
            return carried
        return first(members, state, weighed, links, *more)

    monkeypatch.setattr(jaccard_join, "crossing_links", seen)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs, 5, 80).collect()}
    want = brute(rows, 5, 80)
    shingles = sum(brute([(0, text)], 5, 80)[0][0] for text in {text for _, text in rows})
    assert got == want and sent[0] < shingles


def test_pairs_that_only_bitmaps_take_for_links_are_compared_again(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = jaccard_join.parity_links
    monkeypatch.setattr(jaccard_join, "parity_links", lambda percent: first(percent - 25))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()}
    assert got == brute(rows, 4, 85)


def test_only_sets_that_a_wrong_link_joined_are_compared_again(spark):
    groups = spark.createDataFrame([(7, sid) for sid in range(1, 8)] + [(8, 1), (8, 4), (8, 5)], "key long, sid long")
    # Sets 2 and 3 are one component already.
    state = spark.createDataFrame([(sid, 2 if sid == 3 else sid) for sid in range(1, 8)], "sid long, comp long")
    named = spark.createDataFrame([(1, 2, 7), (4, 5, 7), (5, 6, 7), (4, 5, 8)], "a long, b long, key long")
    wrong = named.filter("a = 1")
    got = jaccard_join.misled(groups, state, named, wrong).collect()
    assert sorted(r.sid for r in got) == [1, 2, 3] and len({r.key for r in got}) == 1
