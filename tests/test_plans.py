import random

from pyspark.sql import functions as F

from shelfmark.functions.text import fuzzy_bucket, title_numbers, title_similarity
from shelfmark.operators import curation, fuzzy
from shelfmark.plans import components
from shelfmark.plans.components import connected_components
from shelfmark.plans.skew import lookup_join


def test_lookup_join_equals_a_plain_join_with_hot_and_null_keys(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
                                    .otherwise((F.col("id") % 50).cast("string")).alias("k"))
    counts = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("left", "inner"):
        want = rows.join(counts, "k", how).select("id", "k", "n")
        for hot in (1, 5):
            got = lookup_join(rows, counts, ["k"], "n", how, salt_on=["id"], hot_keys=hot).select("id", "k", "n")
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_components_of_chain_cycle_star_and_self_pair(spark):
    chain = [(n, n + 1) for n in range(100, 160)]
    pairs = chain + [(1, 2), (2, 3), (3, 1), (5, 5)] + [(1000, n) for n in range(1001, 1040)]
    random.Random(7).shuffle(pairs)
    frame = spark.createDataFrame(pairs, "a long, b long")
    roots = {row.node: row.root for row in connected_components(frame, "a", "b").collect()}
    assert {roots[n] for n in range(100, 161)} == {100}
    assert (roots[1], roots[2], roots[3], roots[5]) == (1, 1, 1, 5)
    assert {roots[n] for n in range(1000, 1040)} == {1000}


def test_few_edges_are_joined_without_shuffles(spark, monkeypatch, capsys):
    pairs = [(n, n + 1) for n in range(100, 130)] + [(1, 2), (2, 3), (3, 1), (5, 5)]
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    plans, checkpoint = [], type(frame).checkpoint

    def seen(rows, *more):
        capsys.readouterr()
        rows.explain()
        plans.append(capsys.readouterr().out)
        return checkpoint(rows, *more)

    monkeypatch.setattr(type(frame), "checkpoint", seen)
    few = {tuple(row) for row in connected_components(frame, "a", "b").collect()}
    # The first plan reads the pairs, the others are the rounds.
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in plan for plan in plans[1:])
    monkeypatch.setattr(components, "FEW", 0)
    assert few == {tuple(row) for row in connected_components(frame, "a", "b").collect()}


def brute_force(titles, max_bucket):
    a, b = titles.alias("a"), titles.alias("b")
    bucket = lambda side: fuzzy_bucket(F.col(f"{side}.normalised_title"))
    joined = a.join(b, (F.col("a.system_key") == F.col("b.system_key")) & (F.col("a.id") < F.col("b.id"))
                    & (bucket("a") == bucket("b")))
    ta, tb = F.col("a.normalised_title"), F.col("b.normalised_title")
    pairs = joined.filter((ta != tb) & (title_numbers(ta) == title_numbers(tb))
                          & (title_similarity(ta, tb) >= 0.85))
    got = {(r[0], r[1]) for r in pairs.select("a.id", "b.id").collect()}
    if max_bucket is None:
        return got
    sizes = {}
    rows = titles.select("id", "system_key", fuzzy_bucket(F.col("normalised_title")).alias("b")).collect()
    for row in rows:
        sizes.setdefault((row.system_key, row.b), []).append(row.id)
    fit = {n for ids in sizes.values() if len(ids) <= max_bucket for n in ids}
    return {pair for pair in got if pair[0] in fit}


def test_fuzzy_pairs_equal_brute_force(spark):
    draw = random.Random(3)
    rows, base = [], []
    for n in range(500):
        if base and draw.random() < 0.7:
            title = list(draw.choice(base))
            for _ in range(draw.randint(0, 4)):
                at = draw.randrange(len(title))
                title[at:at + draw.randint(0, 1)] = draw.choice(["", "a", "b", "z", "7", "é"])
            title = "".join(title) or "x"
        else:
            title = "".join(draw.choice("abcde3") for _ in range(draw.randint(1, 34)))
        base.append(title)
        rows.append((f"s{draw.randint(0, 1)}", n, title))
    titles = spark.createDataFrame(rows, "system_key string, id long, normalised_title string").cache()
    for cap in (None, 20):
        found = curation.fuzzy_title_pairs(titles, max_bucket=cap).select("id_a", "id_b").collect()
        got = {(r.id_a, r.id_b) for r in found}
        assert len(found) == len(got) and got == brute_force(titles, cap)
        assert len(got) > 20 or cap


def test_fuzzy_examples(spark):
    titles = ["lantern of the marsh", "lantirn of the marsh", "nine quiet harbours", "ferryman 1", "ferryman 2", "ferryman 3",
              "cellar beneath the mill", "cellar beneath the mill 2", "lantern of the marsh"]
    frame = spark.createDataFrame([("s", n, t) for n, t in enumerate(titles)], "system_key string, id long, normalised_title string")
    pairs = curation.fuzzy_title_pairs(frame).collect()
    assert {(p.id_a, p.id_b) for p in pairs} == {(0, 1), (1, 8)} and all(p.similarity > 0.9 for p in pairs)


def test_copies_of_a_title_are_compared_once(spark, monkeypatch):
    titles = ["lanternofthemarsh", "lantirnofthemarsh", "lanternsofthemarsh", "ninequietharbours"]
    frame = spark.createDataFrame([("s", 10 * copy + n, t) for copy in range(9) for n, t in enumerate(titles)],
                                  "system_key string, id long, normalised_title string")
    seen, meet = [], fuzzy.title_meetings
    def counted(rows, *more):
        seen.append(rows.count())
        return meet(rows, *more)
    monkeypatch.setattr(fuzzy, "title_meetings", counted)
    pairs = [(p.id_a, p.id_b) for p in fuzzy.fuzzy_title_pairs(frame).collect()]
    assert seen == [len(titles)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_force(frame, None) and len(pairs) >= 81
