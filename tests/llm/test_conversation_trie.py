import random
import zlib
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from shelfmark.llm import conversation_trie as tries
from shelfmark.llm import running


def brute(rows, rebuilt=True):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {conv: [(role, text) for _, _, role, text in sorted(found)] for conv, found in turns.items()}
    whole = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6 if rebuilt else 0
        whole[conv] = tuple(turns.get(conv - conv % 100, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for conv, sequence in whole.items():
        for depth in range(len(sequence) + 1):
            nodes[sequence[:depth]].append(conv)
    children = defaultdict(int)
    for node in nodes:
        if node:
            children[node[:-1]] += 1
    out = {}
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(node))
        inside = [x for x in nodes if x[:len(node)] == node]
        out[node] = (min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), children[node],
                     sum(children[x] == 0 for x in inside), sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in inside if x),
                     sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def some_rows():
    rng = random.Random(4)
    rows = []
    for conv in [*range(0, 14), 100, 105, 117, 203, 204, 299, 700]:
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "né", None, "", "long " * 40, "a"])))
    rows += [(300, None, "user", "first"), (300, 4, "user", "x"), (301, 1, "a", "bc"), (302, 1, "ab", "c"), (300, 4, "user", "x")]
    rows += [(conv, turn, "user", "same") for conv in range(800, 860) for turn in range(4)]
    rows += [(900, turn, "user", f"turn {turn}") for turn in range(60)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_equals_brute_force(spark):
    rows = some_rows()
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as node").repartition(7)
    assert sorted(map(tuple, tries.op12_conversation_trie(table).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, tries.conversation_trie(table).collect()), key=str) == brute(rows, rebuilt=False)


def test_nulls_and_empty(spark):
    table = spark.createDataFrame([(None, 1, "user", "x"), (7, 1, None, None)], SCHEMA)
    assert sorted(map(tuple, tries.conversation_trie(table).collect()), key=str) == brute([(7, 1, None, None)], rebuilt=False)
    assert tries.op12_conversation_trie(table.limit(0)).count() == 0


def test_long_lists_are_hashed_in_pieces(spark):
    rows = spark.range(0, 60_000).select(F.struct(F.lit(1).cast("long").alias("depth"), (F.col("id") % 3 == 0).cast("long").alias("a"), F.lit(5).cast("long").alias("b"))
                                         .alias("node"), F.col("id").alias("member"))
    got = {r.node.a: r.digest for r in tries.list_digests(rows, "node", "member").collect()}
    for a in (0, 1):
        assert got[a] == sha256(",".join(str(n) for n in range(60_000) if (n % 3 == 0) == a).encode()).hexdigest()


def test_running_totals_of_a_hot_key(spark):
    rows = spark.range(0, 5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("long").alias("key"),
                                       F.col("id").alias("at"), (F.col("id") % 7).alias("value"))
    got = running.running_totals(rows, "key", ["at DESC"], {"total": "value"}, "number", "test")
    hot = sorted((r.number, r.at, r.total) for r in got.filter("key = 0").collect())
    ids = [n for n in range(4998, -1, -2)]
    assert [at for _, at, _ in hot] == ids and [n for n, _, _ in hot] == list(range(1, len(ids) + 1))
    assert hot[-1][2] == sum(n % 7 for n in ids)
    assert got.filter("key <> 0 and number = 1 and total = value").count() == 2500
