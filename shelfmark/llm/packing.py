"""Harmonic packing of token sequences.

Bins hold C tokens. A piece of v tokens belongs to the class of reciprocal
capacity C/k with k = floor(C / v), and k pieces of one length fill a bin. Since a
document may be cut anywhere, it is cut to full bins first, then greedily into
pieces whose length is exactly floor(C / k), and a short rest is a class of its
own length: every full bin wastes fewer than k tokens. Each task numbers its own
pieces within each class; one small table of counts turns these numbers into bins,
so tasks fill bins without talking to each other. The last, incomplete bin of
each class (fewer than k pieces, so a bounded number in all) is packed first-fit.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored, texts

CAPACITY = 2048
#: A rest below this many tokens is not cut any more.
SHORTEST = 64
#: Words whose ids a task keeps at hand; one round may add its own.
WORDS_KEPT = 300_000
#: Bytes of text in one round of array work.
ROUND = 8 << 20
#: Lower-case letters of Latin-1, and ASCII signs but the low line.
LETTERS = "".join(c for c in map(chr, range(256)) if c.islower() and c.isalpha() and c not in "\xaa\xb5\xba")
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, size int, place long")


def cut_sizes(capacity: int, shortest: int) -> list[int]:
    """The lengths floor(C / k), from C down to ``shortest``."""
    return sorted({capacity // k for k in range(1, capacity // shortest + 1)}, reverse=True)


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, shortest: int = SHORTEST,
           end_id: int = 1) -> DataFrame:
    """Cut documents: one row per piece, with its class (size) and its place among its task's pieces of that class."""
    sizes_, end = cut_sizes(capacity, shortest), end_id.to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator:
        import json
        import os
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
        tokenizer = Tokenizer.from_str(tokenizer_json)
        # The same merges without the costly normaliser and patterns, for words that they leave as they are.
        bare = json.loads(tokenizer_json)
        bare |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        plain = Tokenizer.from_str(json.dumps(bare))
        ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
        ends_word[[n for token, n in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        known: dict[str, bytes] = {}  # ids of words and of signs
        part, places = TaskContext.get().partitionId(), {}

        def learn(new, simple):
            """Ids of strings that hold no white space; simple ones are lower-case Latin-1 letters, one word each."""
            for at in range(0, len(new), 20_000):
                some = new[at:at + 20_000]
                if simple:
                    ids = np.asarray(plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                    stops = (4 * (np.flatnonzero(ends_word[ids]) + 1)).tolist()
                    flat = ids.tobytes()
                    known.update(zip(some, (flat[i:j] for i, j in zip([0, *stops], stops, strict=False)), strict=True))
                else:
                    made = tokenizer.encode_batch_fast(some, add_special_tokens=False)
                    known.update((word, np.asarray(one.ids, np.uint32).tobytes()) for word, one in zip(some, made, strict=True))

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            edges = np.flatnonzero(np.diff(sizes // ROUND, prepend=-1))
            for begin, stop in zip(edges, np.append(edges[1:], len(sizes)), strict=True):
                some = batch.slice(begin, stop - begin)
                # Lower case as the tokenizer has it within Latin-1; other texts are left to the tokenizer.
                beyond = pc.match_substring_regex(some.column("text"), r"[^\x00-\x{ff}]")
                lists = pc.ascii_split_whitespace(pc.if_else(beyond, some.column("text"), pc.utf8_lower(some.column("text"))))
                coded = lists.flatten().dictionary_encode()
                # No token crosses white space, nor the place between letters and the signs that close a chunk.
                front = pc.utf8_rtrim(coded.dictionary, SIGNS)
                is_word = pc.and_(pc.equal(pc.utf8_ltrim(front, LETTERS), ""), pc.not_equal(front, ""))
                words = pc.if_else(is_word, front, coded.dictionary).dictionary_encode()
                signs = pc.if_else(is_word, pc.utf8_ltrim(coded.dictionary, LETTERS), "").dictionary_encode()
                simple = np.zeros(len(words.dictionary), bool)
                simple[words.indices.to_numpy()[is_word.to_numpy(zero_copy_only=False)]] = True
                if len(known) > WORDS_KEPT:
                    known.clear()
                distinct, ends = words.dictionary.to_pylist(), signs.dictionary.to_pylist()
                learn([word for word, yes in zip(distinct, simple.tolist(), strict=True) if yes and word not in known], True)
                learn([word for word, yes in zip(distinct, simple.tolist(), strict=True) if not yes and word not in known], False)
                learn([sign for sign in ends if sign not in known], False)
                found = [known[word] for word in [*distinct, *ends]]
                lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
                first = np.cumsum(lengths) - lengths
                pair = np.stack([words.indices.to_numpy(), signs.indices.to_numpy() + len(distinct)], axis=1)
                flat, codes = np.frombuffer(b"".join(found), np.uint32), pair[coded.indices.to_numpy()].reshape(-1)
                each = lengths[codes]
                behind = np.cumsum(each)
                ids = flat[np.repeat(first[codes] - (behind - each), each) + np.arange(behind[-1] if len(behind) else 0)]
                last = 2 * np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                stops_ = np.concatenate([[0], behind])[last].tolist()
                rows, at = [[] for _ in range(8)], 0
                for doc_id, till in zip(some.column("doc_id").to_pylist(), stops_, strict=True):
                    own = ids[at:till].tobytes() + end
                    at, total, start = till, till - at + 1, 0
                    while start < total:
                        left = total - start
                        size = left if left < shortest else next(v for v in sizes_ if v <= left)
                        place = places.get(size, 0)
                        places[size] = place + 1
                        crc = zlib.crc32(own[4 * start:4 * (start + size)])
                        for column, value in zip(rows, (doc_id, start, size, crc, total, part, size, place), strict=True):
                            column.append(value)
                        start += size
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()], strict=True)],
                                                 names=[c.split()[0] for c in PIECES.split(", ")])

    return texts(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, shortest: int = SHORTEST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    An empty or null text is its end id alone; rows that repeat a doc_id are packed
    each; no rows give no rows; further columns are ignored. Memory in a task is one
    batch of texts and the words at hand, whatever the number of documents.
    """
    cut = stored(pieces(docs, tokenizer_json, capacity, shortest), "pieces")
    counts = cut.groupBy("size", "part").agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("size").orderBy("part")
    offsets = counts.select("size", "part", (F.sum("n").over(by_part) - F.col("n")).alias("before"),
                            F.sum("n").over(Window.partitionBy("size")).alias("all"))
    placed = (cut.join(offsets, ["size", "part"])
              .withColumn("nth", F.col("before") + F.col("place"))
              .withColumn("k", F.expr(f"{capacity} div size")))
    full = F.col("nth") < F.col("all") - F.col("all") % F.col("k")
    whole = placed.filter(full).withColumn("sequence_id", F.shiftleft(F.col("size").cast("long"), 44) + F.expr("nth div k"))
    whole = whole.withColumn("offset", (F.col("nth") % F.col("k")) * F.col("size"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def first_fit(rows):
        # At most k - 1 pieces of each class come here: a number fixed by capacity and shortest.
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        room, bins, offsets_ = [], [], []
        for length in rows["length"]:
            at = next((b for b, left in enumerate(room) if left >= length), len(room))
            if at == len(room):
                room.append(capacity)
            bins.append(at)
            offsets_.append(capacity - room[at])
            room[at] -= length
        return rows.assign(sequence_id=bins, offset=offsets_)[columns]

    rest = (placed.filter(~full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                        F.lit(0).alias("one"))
            .groupBy("one").applyInPandas(first_fit, "doc_id long, start long, length long, ids_crc32 long, "
                                                        "doc_tokens long, sequence_id long, offset long"))
    return whole.select(columns).unionByName(rest)


def op3_packing(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return pack(docs, file.read())
