import hashlib
import re

from shelfmark.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(digest, []).append(doc_id)
    return sorted((d, min(ids), len(ids), d == min(ids), digest) for digest, ids in groups.items() for d in ids)


def test_equals_brute_force_with_hot_and_light_groups(spark):
    rows = [(n, "hot \t copy" if n % 3 == 0 else f"text {n // 5}\n" if n % 2 else None if n % 7 == 0 else "") for n in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as digest", "1 as kept").repartition(7)
    for heavy in (1, 1000):
        got = sorted(tuple(r) for r in exact_dedup.mark(docs, heavy=heavy).collect())
        assert got == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a"), (5, "a"), (None, "a"), (None, "b"), (7, "c")], "doc_id long, text string")
    got = exact_dedup.mark(docs).collect()
    assert sum(r.kept for r in got) == 3
    assert sorted((r.keep_id or -1) for r in got if r.kept) == [-1, 5, 7]
    assert exact_dedup.mark(docs.limit(0)).count() == 0


def test_keep_first_returns_whole_rows(spark):
    rows = [(1, "a  b", "x"), (2, "a b", "y"), (3, None, "z"), (4, "", None)]
    docs = spark.createDataFrame([*rows, rows[0], rows[1]], "doc_id long, text string, kept string")
    assert sorted(exact_dedup.keep_first(docs).collect()) == [(1, "a  b", "x"), (3, None, "z")]
    assert exact_dedup.keep_first(docs.limit(0)).columns == docs.columns
