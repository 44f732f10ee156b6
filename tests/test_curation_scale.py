"""Hot title pieces, merges that are remembered, pages by ranges, catalogs in chunks."""

import random

from pyspark.sql import functions as F

from shelfmark.functions.text import base_name, fuzzy_bucket, parent_of, title_numbers, title_similarity
from shelfmark.operators import aliases, duplicate_counts, fuzzy, paging, views
from shelfmark.sources import catalog_chunks, catalogs
from shelfmark.sources.state import create_state


def test_titles_with_one_prefix_equal_brute_force(spark):
    rng = random.Random(8)
    prefix = "supermariobr"
    titles = []
    for n in range(260):
        tail = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(6, 11)))
        titles.append(prefix + tail)
        if n % 6 == 0:
            at = rng.randrange(len(prefix), len(prefix) + len(tail))
            titles.append((prefix + tail)[:at] + rng.choice("xyz") + (prefix + tail)[at + rng.randint(0, 1):])
        if n % 20 == 0:
            titles.append(prefix[:5] + "z" + prefix[6:] + tail)
    rows = spark.createDataFrame([("S", n, t) for n, t in enumerate(titles)], "system_key string, id int, normalised_title string")
    got = {(r.id_a, r.id_b) for r in fuzzy.fuzzy_title_pairs(rows, hot_titles=15).collect()}
    assert got == {(r.id_a, r.id_b) for r in fuzzy.fuzzy_title_pairs(rows, hot_titles=10_000).collect()}
    a, b = rows.alias("a"), rows.alias("b")
    one, two = F.col("a.normalised_title"), F.col("b.normalised_title")
    want = a.join(b, (F.col("a.id") < F.col("b.id")) & (one != two) & (fuzzy_bucket(one) == fuzzy_bucket(two)) & (title_numbers(one) == title_numbers(two))
                  & (title_similarity(one, two) >= 0.85)).select("a.id", "b.id")
    assert got == {tuple(r) for r in want.collect()} and got
    # Pairs that meet: all of a prefix before, a small part of them with the split.
    met = fuzzy.title_meetings(rows, hot_titles=15).count()
    assert met < 0.25 * fuzzy.title_meetings(rows, hot_titles=10_000).count() and met < len(titles) ** 2 / 10


def test_merges_are_remembered(spark):
    rng = random.Random(3)
    games = spark.createDataFrame([(n,) for n in range(60)], "game_key long")
    table, known, alive = aliases.empty_aliases(games), {}, set(range(60))
    for _ in range(4):
        gone = rng.sample(sorted(alive), 12)
        kept = sorted(alive - set(gone))
        batch = [(g, rng.choice(kept)) for g in gone]
        alive -= set(gone)
        moved = dict(batch)
        known = {k: moved.get(r, r) for k, r in known.items()} | moved
        table = aliases.record_merges(table, spark.createDataFrame(batch, "game_key long, keep_key long")).checkpoint()
        assert {r.game_key: r.root_key for r in table.collect()} == known
    files = spark.createDataFrame([(f"f{n}", n % 61) for n in range(300)] + [("none", None)], "file_key string, game_key long")
    assert {r.file_key: r.game_key for r in aliases.follow_aliases(files, table).collect()} == (
        {f"f{n}": known.get(n % 61, n % 61) for n in range(300)} | {"none": None})
    # A game that exists again and is kept is no alias any more.
    back = next(iter(known))
    again = aliases.record_merges(table, spark.createDataFrame([(min(alive), back)], "game_key long, keep_key long"))
    found = {r.game_key: r.root_key for r in again.collect()}
    assert back not in found and found[min(alive)] == back and not set(found.values()) & set(found)
    assert aliases.forget_merges(table, games).count() == 0


def test_pages_of_an_index_equal_pages_by_offset(spark):
    games = spark.createDataFrame([(n, "S", f"t{n % 50:03}", f"t{n % 50:03}", "x", n % 2 == 0) for n in range(230)],
                                  "game_key long, system_key string, title string, sort_title string, normalised_title string, is_wanted boolean").repartition(4)
    files = spark.createDataFrame([(f"/f{n}", f"/f{n}", n, "Normal", n, "Unknown", None, None, False) for n in range(0, 230, 3)],
                                  "file_key string, path string, game_key long, status string, size long, catalog_status string, catalog_name string, "
                                  "region string, is_preferred boolean").withColumn("file_name", F.col("path"))
    systems = spark.createDataFrame([("S", "System")], "system_key string, system_name string")
    index = paging.page_index(games, files, view="Wanted")
    for skip, take in ((0, 10), (37, 40), (100, 50), (114, 1), (115, 5), (500, 5)):
        want = views.page_games(games, files, systems, skip, take, view="Wanted").collect()
        assert paging.index_page(index, files, systems, skip, take).collect() == want


def test_catalogs_in_chunks_equal_whole_ones(spark, tmp_path):
    rng = random.Random(6)
    vocab = ["game", "machine", "rom", "disk", "note", "name", "size", "(", ")", '"a (b) \\" c"', '"x)"', '"', "word", "sha1", "description", "\n", 'q"r', "\t"]
    for n in range(30):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80)))
        if n % 2:
            text = "\n".join(f'game ( name "g{i} (U)" rom ( name "r(1)" size {i} ) note ( x ( y ) ) {"description q" if i % 2 else ""} disk ( sha1 ab ) )'
                             for i in range(rng.randint(1, 9))) + text
        (tmp_path / f"c{n}.dat").write_text(text + ")")
    (tmp_path / "xml.dat").write_text("  <datafile><game name='a'><rom name='b'/></game></datafile>")
    whole = catalogs.parse_catalog_text(spark.read.text(str(tmp_path), wholetext=True).select(
        F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("source_file"), "value"))
    for chunk in (1, 40, 1 << 20):
        got = catalogs.read_catalog_text(spark, str(tmp_path), chunk)
        assert got.columns == whole.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert whole.count() > 50


def test_a_change_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    rows = spark.range(0, 2000).selectExpr("CAST(id AS STRING) AS file_key", "id AS size")
    state = create_state(rows, str(tmp_path / "state"), "file_key", 32)
    want = {str(n): n for n in range(2000)}
    changed = spark.createDataFrame([("7", 70), ("new", 1)], "file_key string, size long")
    touched = state.merge(0, changed)
    assert len(touched) <= 2 and {p.name for p in (tmp_path / "state/data/1").iterdir() if p.is_dir()} == {f"bucket={b}" for b in touched}
    after = want | {"7": 70, "new": 1}
    assert {r.file_key: r.size for r in state.read(1).collect()} == after
    state.merge(1, removed=spark.createDataFrame([("new",), ("12",), ("none",)], "file_key string"))
    # A run that is repeated gives the same version again, and older ones stay.
    state.merge(1, removed=spark.createDataFrame([("new",), ("12",), ("none",)], "file_key string"))
    assert {r.file_key: r.size for r in state.read(2).collect()} == {k: v for k, v in after.items() if k not in ("new", "12")}
    assert {r.file_key: r.size for r in state.read(0).collect()} == want
    empty = create_state(rows.limit(0), str(tmp_path / "empty"), "file_key", 4)
    assert empty.read(0).count() == 0 and empty.merge(0, changed) and empty.read(1).count() == 2
    empty.merge(1, removed=changed.select("file_key"))
    assert empty.read(2).count() == 0


def test_duplicates_follow_the_runs(spark, tmp_path):
    rng = random.Random(5)
    present = {f"f{n}": f"s{rng.randint(0, 40)}" for n in range(60)}
    table = lambda rows: spark.createDataFrame(sorted(rows.items()), "file_key string, sha256 string")
    whole = lambda rows: {k: "Duplicate" if sum(v == s for s in rows.values()) > 1 else "Normal" for k, v in rows.items()}
    state = duplicate_counts.start_counts(table(present), str(tmp_path / "counts"), 8)
    status = whole(present)
    for run in range(4):
        lost = {k: present[k] for k in rng.sample(sorted(present), 15)}
        gained = {f"r{run}n{n}": f"s{rng.randint(0, 45)}" for n in range(12)} | {k: "changed" for k in list(lost)[:3]}
        present = {k: v for k, v in present.items() if k not in lost} | gained
        changes = {r.file_key: r.status for r in duplicate_counts.follow_run(state, run, table(gained), table(lost), table(present)).collect()}
        status = {k: changes.get(k, status.get(k)) for k in present}
        assert status == whole(present)


def test_rows_that_no_change_names_stay_where_they_are(spark, tmp_path):
    rows = spark.range(0, 3000).selectExpr("CASE WHEN id < 2 THEN NULL WHEN id < 4 THEN 'twice' ELSE CAST(id AS STRING) END AS file_key", "id AS size")
    state = create_state(rows, str(tmp_path / "state"), "file_key", 4)
    named = spark.createDataFrame([("7",), ("twice",), (None,)], "file_key string")
    clear, may = state._parted(state.read(0), named)
    assert {r.file_key for r in may.collect()} >= {"7", "twice"} and may.count() < 30 and clear.count() + may.count() == 3000
    assert not {r.file_key for r in clear.collect()} & {"7", "twice"}
    # Rows without a key are never replaced, nor are changed rows merged; a key in both tables is replaced.
    changed = spark.createDataFrame([("7", 70), ("7", 71), (None, 5)], "file_key string, size long")
    state.merge(0, changed, named)
    got = sorted((r.file_key or "", r.size) for r in state.read(1).collect())
    assert got == sorted([("", 0), ("", 1), ("", 5), ("7", 70), ("7", 71)] + [(str(n), n) for n in range(4, 3000) if n != 7])
    # So it is where most rows are named and all are dealt anew.
    most = spark.range(4, 2500).selectExpr("CAST(id AS STRING) AS file_key")
    state.merge(1, changed, most)
    got = sorted((r.file_key or "", r.size) for r in state.read(2).collect())
    assert got == sorted([("", 0), ("", 1), ("", 5), ("", 5), ("7", 70), ("7", 71)] + [(str(n), n) for n in range(2500, 3000)])


def test_files_meet_the_changes_once_where_they_tell_which_are_gained(spark, tmp_path):
    rows = [("a", "s", False), ("b", "s", True), ("c", "t", False), ("c", "t", False), ("d", "u", True), ("e", None, True), (None, "v", True), ("f", "w", None)]
    present = spark.createDataFrame(rows, "file_key string, sha256 string, late boolean")
    first, gained = present.filter("NOT late"), present.filter("late")
    gone = spark.createDataFrame([("x", "t")], "file_key string, sha256 string")
    path = str(tmp_path / "state")
    one = duplicate_counts.start_counts(first.unionByName(gone, allowMissingColumns=True), path, 4)
    want = sorted(map(tuple, duplicate_counts.follow_run(one, 0, gained, gone, present).collect()), key=str)
    assert want == sorted(map(tuple, duplicate_counts.follow_run(one, 0, gained, gone, present, flag="late").collect()), key=str) and len(want) == 4
    counts = duplicate_counts.count_copies(first)
    two = duplicate_counts.start_counts(first, str(tmp_path / "two"), 4, counts)
    assert sorted(map(tuple, two.read(0).collect())) == sorted(map(tuple, counts.collect()))


def test_a_chunk_is_cut_into_tokens_once_for_each_way_to_begin(monkeypatch):
    cut, calls = catalog_chunks.tokens, []
    monkeypatch.setattr(catalog_chunks, "tokens", lambda text, quoted: calls.append(quoted) or cut(text, quoted))
    text = 'a ( b ( c "x)" ) ) ) ) game ( rom ( name "y'
    found = catalog_chunks.reports(text)
    assert calls == [False, True] and len(found) > 4
    for quoted, depth, *end in found:
        inside, at, opened, _ = catalog_chunks.walk(cut(text, quoted), depth)
        assert end == [inside, at, opened]


def test_places_in_a_path_are_found_without_patterns(spark, texts):
    paths = ["/a/b/c.bin", "/a", "a", "", "/", "a/", "//", "é/ü\n/x", None]
    assert texts(paths, parent_of) == ["/a/b", "", "a", "", "", "a", "/", "é/ü\n", None]
    assert texts(paths, base_name) == ["c.bin", "a", "a", "", "", "", "", "x", None]
    assert "regexp" not in str(parent_of(F.col("x"))) + str(base_name(F.col("x")))
