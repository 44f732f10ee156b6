import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import packing

MESSY = ["", None, "Hello  World", "it's   <|endoftext|>x 12 34\tÉCOLE École\r\n\x1cz", " " * 50, "ΑΣ ΟΔΟΣ.",
         "longword" * 900, "one two three " * 2500, "a b ́c", "same text", "same text"]


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def verify(rows, texts):
    whole = {n: expected_ids(text) for n, text in texts.items()}
    cover, bins = {}, {}
    for r in rows:
        ids = whole[r.doc_id][r.start:r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(cover) == set(whole)
    for parts in [*cover.values(), *bins.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert all(sum(length for _, length in parts) <= packing.CAPACITY for parts in bins.values())
    for n, parts in cover.items():
        assert sum(length for _, length in parts) == len(whole[n])
    return bins


def test_messy_texts_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(MESSY)), "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 as start", "'a' as size")
    verify(packing.op3_packing(docs).collect(), dict(enumerate(MESSY)))


def test_corpus_round_trip_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    texts = {r.doc_id: r.text for r in docs.collect()}
    bins = verify(packing.op3_packing(docs).collect(), texts)
    used = [sum(length for _, length in parts) for parts in bins.values()]
    padding = sum(packing.CAPACITY - n for n in used if n & (n - 1))
    assert padding < 0.02 * sum(used)


def test_cut_sizes_are_reciprocal():
    sizes = packing.cut_sizes(2048, 64)
    assert sizes[0] == 2048 and sizes[-1] == 64 and 682 in sizes


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    got = packing.op3_packing(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.length, r.offset) for r in got] == [(1, 0)] * len(rows)
