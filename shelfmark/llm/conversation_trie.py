"""Prefix trie of conversations by collapse of whole sequences.

Every prefix of a conversation has a fingerprint: the running sum of hashes of its turns with their
places, four lanes of 32 bits, so that prefixes need neither their texts nor their predecessors. Whole conversations with
equal fingerprints become one weighted sequence with the list of the conversations that end there. A sequence
that is a proper prefix of another one drops out by an anti-join; the rest are the leaves. Only the prefixes of distinct sequences
are then aggregated to nodes, with the sequences' weights. What a node's subtree holds is added up along sequences: each node
belongs to the sequence of its smallest member, values are summed from the end of each sequence, and a node takes the sum at
its depth from every sequence through it.

Turns are dealt by ranges, so neither a conversation nor a group of copies has to fit into one task. The
digest of a list of ends has to see the list in one go: ranges of it are joined to blocks of text all over the cluster, and
only those blocks run through one hash, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored
from shelfmark.llm.running import running_totals
from shelfmark.plans.skew import lookup_join

#: Conversations of a block borrow the opening of its first one: ids per block, and turns that can be borrowed at most.
BLOCK, BORROWED = 100, 5
#: Characters of a list of ends that are handed over at a time.
PIECE = 1 << 16
LANES = ("t1", "t2", "t3", "t4")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n_chars): turns in order of ``turn``, null first; ties by role, then by the turn's digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = (conversations.filter("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                    F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("digest"), F.length(text).cast("long").alias("n_chars")))
    return running_totals(rows, "conv_id", ["turn", "role", "digest"], {}, "place", "turns").select("conv_id", "place", "digest", "n_chars")


def with_borrowed_openings(turns: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: (conv_id, depth, digest, n_chars), with a row of depth 0 for each conversation.

    The first h turns of conversation c come from conversation c - c % 100, with h = crc32 of the decimal c modulo 6.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (BORROWED + 1)
    everyone = turns.filter("place = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("lender"))
    openings = turns.filter((F.col("conv_id") % BLOCK == 0) & (F.col("place") <= BORROWED)).withColumnRenamed("conv_id", "lender")
    borrowed = (everyone.join(openings, "lender").filter("place <= h")
                .select("conv_id", F.col("place").alias("depth"), "digest", "n_chars"))
    counts = borrowed.groupBy("conv_id").agg(F.count("*").alias("got"))
    own = (turns.filter(F.col("place") > h).join(counts, "conv_id", "left")
           .select("conv_id", (F.col("place") - h + F.coalesce("got", F.lit(0))).alias("depth"), "digest", "n_chars"))
    root = everyone.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"),
                           F.lit(0).cast("long").alias("n_chars"))
    return root.unionByName(borrowed).unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, node, above, n_chars) of every prefix; ``turns`` has conv_id, depth (each from 0 on, 0 for the root), digest, n_chars.

    ``node``: (depth, a, b), the fingerprint of the prefix; ``above``: that of the prefix without its last turn.
    """
    one, two = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit(1))
    halves = [F.shiftrightunsigned(one, 32), one.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(two, 32), two.bitwiseAND(0xFFFFFFFF)]
    hashed = turns.select("conv_id", "depth", "n_chars", *[F.when(F.col("depth") > 0, half).otherwise(F.lit(0)).cast("long").alias(name)
                                                             for name, half in zip(LANES, halves, strict=True)])
    summed = running_totals(hashed, "conv_id", ["depth"], {f"s_{name}": name for name in LANES}, "number", "prefixes")

    def print_of(depth, lanes):
        return F.struct(depth.alias("depth"), F.xxhash64(*lanes).alias("a"), F.xxhash64(F.lit(1), *lanes).alias("b"))

    now, then = [F.col(f"s_{name}") for name in LANES], [F.col(f"s_{name}") - F.col(name) for name in LANES]
    return summed.select("conv_id", print_of(F.col("depth"), now).alias("node"),
                         F.when(F.col("depth") > 0, print_of(F.col("depth") - 1, then)).alias("above"), "n_chars")


def list_digests(rows: DataFrame, node: str, member: str) -> DataFrame:
    """(node, digest): SHA-256 of each node's members as decimal numbers, ascending, joined by commas."""
    flat = rows.select(F.col(f"{node}.depth").alias("depth"), F.col(f"{node}.a").alias("a"), F.col(f"{node}.b").alias("b"), F.col(member).alias("member"))
    order = ["depth", "a", "b", "member"]

    def pieces(frames: Iterator) -> Iterator:
        import pandas as pd

        held, words, size = None, [], 0  # (depth, a, b, first member) of the open piece
        for frame in frames:
            columns = [frame[name].to_numpy() for name in order]
            opens = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])]))
            out = []
            for low, high in zip(opens.tolist(), [*opens[1:].tolist(), len(frame)], strict=True):
                named = tuple(int(c[low]) for c in columns[:3])
                if held is not None and (held[:3] != named or size >= PIECE):
                    out.append((*held, ",".join(words)))
                    held, words, size = None, [], 0
                for at in range(low, high, PIECE):
                    added = [str(x) for x in columns[3][at:min(high, at + PIECE)].tolist()]
                    if held is not None and size >= PIECE:
                        out.append((*held, ",".join(words)))
                        held, words, size = None, [], 0
                    held = held or (*named, int(added[0]))
                    words += added
                    size += sum(map(len, added))
            yield pd.DataFrame(out, columns=[*order, "piece"])
        if held is not None:
            yield pd.DataFrame([(*held, ",".join(words))], columns=[*order, "piece"])

    def digests(frames: Iterator) -> Iterator:
        from hashlib import sha256

        import pandas as pd

        held, state = None, None
        for frame in frames:
            out = []
            for depth, a, b, _, piece in frame.itertuples(index=False):
                if held == (depth, a, b):
                    state.update(b",")
                else:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = (depth, a, b), sha256()
                state.update(piece.encode())
            yield pd.DataFrame(out, columns=["depth", "a", "b", "digest"])
        if held is not None:
            yield pd.DataFrame([(*held, state.hexdigest())], columns=["depth", "a", "b", "digest"])

    cut = flat.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pieces, "depth long, a long, b long, member long, piece string")
    done = cut.repartition("depth", "a", "b").sortWithinPartitions(*order).mapInPandas(digests, "depth long, a long, b long, digest string")
    return done.select(F.struct("depth", "a", "b").alias("node"), "digest")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (as ``prefixes`` takes them).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    steps = stored(prefixes(turns), "steps")
    ends = stored(steps.groupBy("conv_id").agg(F.max("node").alias("node")), "ends")
    sequences = ends.groupBy("node").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")).withColumnRenamed("node", "whole")
    weighted = stored(steps.join(sequences, "conv_id"), "sequences")
    proper = weighted.filter("node.depth < whole.depth").select("node").distinct()
    leaves = (weighted.filter("node.depth = whole.depth").join(proper, "node", "left_anti")
              .select("conv_id", F.lit(1).cast("long").alias("leaf")))
    nodes = stored(weighted.join(leaves, "conv_id", "left").groupBy("node").agg(
        F.first("above").alias("above"), F.sum("weight").alias("n_convs"), F.min("conv_id").alias("owner"), F.max("n_chars").alias("last_chars"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.count("*").alias("rows")), "nodes")
    spent = (lookup_join(weighted.select("conv_id", "node"), nodes.select("node", "n_convs", "owner", "last_chars", "rows"), ["node"], "rows",
                         "inner", salt_on=["conv_id", "node"])
             .select("conv_id", "node", F.col("node.depth").alias("depth"),
                     F.when(F.col("conv_id") == F.col("owner"), (F.col("n_convs") - 1) * F.col("last_chars")).otherwise(0).alias("value")))
    below = running_totals(spent, "conv_id", ["depth DESC"], {"below": "value"}, "number", "below")
    saved = below.groupBy("node").agg(F.sum("below").alias("saved_tokens"))
    children = nodes.filter("above IS NOT NULL").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.join(children, "node").select(F.col("node").alias("above"), F.col("owner").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    known = lookup_join(nodes, parents, ["above"], "siblings", "left", salt_on=["node"])
    return (known.join(children, "node", "left").join(saved, "node").join(list_digests(ends, "node", "conv_id"), "node", "left")
            .select(F.col("owner").alias("conv_id"), F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs",
                    F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
                    F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are: one row per distinct prefix, as ``trie`` describes.

    A null role or text counts as empty. Turns come in order of ``turn``, null first; ties by role, then by digest, so
    repeated rows are turns of their own. Rows with a null conv_id belong to no conversation. No rows give no
    rows, not even a root. Texts of any length are hashed whole where they are read. Further columns are ignored.
    """
    turns = stored(numbered_turns(conversations), "turns")
    root = turns.filter("place = 1").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"),
                                            F.lit(0).cast("long").alias("n_chars"))
    return trie(root.unionByName(turns.withColumnRenamed("place", "depth")))


def op12_conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt with borrowed openings."""
    return trie(with_borrowed_openings(stored(numbered_turns(conversations), "turns")))


ORACLE = """
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
codes AS (SELECT role, text, row_number() OVER (ORDER BY role, text) AS code, length(text) AS chars FROM (SELECT DISTINCT role, text FROM numbered)),
turns AS (SELECT conv_id, place, code, chars FROM numbered JOIN codes USING (role, text)),
bits AS (SELECT r AS byte, list_reduce(list_prepend(r, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS entry
         FROM (SELECT CAST(range AS BIGINT) AS r FROM range(256))),
crc_table AS (SELECT list(entry ORDER BY byte) AS entries FROM bits),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS lender,
                 xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                 lambda c, x: xor(c // 256, entries[xor(c % 256, x) + 1])), 4294967295) % 6 AS h
          FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
parts AS (
  SELECT c.conv_id, 0 AS part, t.place, t.code, t.chars FROM convs c JOIN turns t ON t.conv_id = c.lender AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.code, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
rebuilt AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, code, chars FROM parts),
steps AS (
  SELECT conv_id, depth, string_agg(CAST(code AS VARCHAR), ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path, chars FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
ends AS (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY 1),
nodes AS (SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, max(chars) AS chars,
                 CASE WHEN min(depth) = 0 THEN NULL WHEN min(depth) = 1 THEN '' ELSE regexp_replace(path, ',[0-9]+$', '') END AS above
          FROM steps GROUP BY path),
lists AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS members FROM steps JOIN ends USING (conv_id, depth) GROUP BY 1),
children AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY 1),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children, coalesce(members, '') AS members
          FROM nodes n LEFT JOIN children USING (path) LEFT JOIN lists USING (path)),
under AS (SELECT s.path AS top, k.path FROM known k JOIN (SELECT DISTINCT conv_id, depth, path FROM steps) s ON s.conv_id = k.conv_id AND s.depth <= k.depth),
sums AS (SELECT u.top AS path, CAST(sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
                CAST(sum((k.n_convs - 1) * k.chars) AS BIGINT) AS saved_tokens
         FROM under u JOIN known k ON k.path = u.path GROUP BY 1)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(k.members) AS ends_sha256
FROM known k JOIN sums s USING (path) LEFT JOIN nodes p ON p.path = k.above
"""
