"""Preference, views, curation, reports and exports on a small hand-made library."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark import model
from shelfmark.operators import curation, preference, views
from shelfmark.sources import sinks

FILE = ("file_key string, game_key string, path string, file_name string, extension string, size long, status string, "
        "catalog_status string, catalog_name string, revision string, file_group string, is_preferred boolean, "
        "is_manual boolean, is_excluded boolean, confidence double, region string, is_directory boolean")
GAME = "game_key string, system_key string, title string, sort_title string, normalised_title string, is_wanted boolean"


@pytest.fixture()
def library(spark):
    def build(files, games=()):
        rows = []
        for given in files:
            row = dict(extension=".nes", size=1, status="Normal", catalog_status="Unknown", catalog_name=None, revision=None,
                       file_group=None, is_preferred=False, is_manual=False, is_excluded=False, confidence=0.9, region="",
                       is_directory=False, game="g", file_name=given["path"].rsplit("/", 1)[-1])
            row.update(given)
            rows.append((row["path"].upper(), row["game"], row["path"], row["file_name"], row["extension"], row["size"],
                         row["status"], row["catalog_status"], row["catalog_name"], row["revision"], row["file_group"],
                         row["is_preferred"], row["is_manual"], row["is_excluded"], row["confidence"], row["region"],
                         row["is_directory"]))
        return (spark.createDataFrame(rows, FILE),
                spark.createDataFrame([(key, system, title, title, title.lower(), wanted)
                                       for key, system, title, wanted in games], GAME))
    return build


def preferred(files):
    return sorted(row.path for row in files.filter("is_preferred").collect())


USA = dict(path="/r/Game (USA).nes", catalog_status="Verified", catalog_name="Test Game (USA)")
JAPAN = dict(path="/r/Game (Japan).nes")


def test_verified_usa_beats_unverified_japan(library):
    files, _ = library([USA, JAPAN])
    assert preferred(preference.elect_preferred(files)) == ["/r/Game (USA).nes"]


def test_beta_loses_and_ties_go_by_folded_path(library):
    files, _ = library([dict(path="/r/A (Beta).nes"), dict(path="/r/A (Europe).nes"),
                        dict(path="/r/b_x.nes", game="h"), dict(path="/r/bZx.nes", game="h"), dict(path="/r/n.nes", game=None)])
    assert preferred(preference.elect_preferred(files)) == ["/r/A (Europe).nes", "/r/bZx.nes"]


def test_unit_wins_or_falls_as_a_whole(library):
    disc = [dict(path=f"/r/d{n} (USA).bin", file_group="Disc 1") for n in range(3)]
    files, _ = library([*disc, dict(path="/r/single (Japan).iso")])
    assert len(preferred(preference.elect_preferred(files))) == 3
    disc[1]["is_excluded"] = True
    files, _ = library([*disc, dict(path="/r/single (Japan).iso")])
    assert preferred(preference.elect_preferred(files)) == ["/r/single (Japan).iso"]
    files, _ = library([dict(path="/r/a", is_excluded=True), dict(path="/r/b", status="Missing")])
    assert preferred(preference.elect_preferred(files)) == []


def test_manual_choice_and_exclusion(library, spark):
    files, _ = library([USA, {**JAPAN, "is_manual": False}, dict(path="/r/other.nes", game="h", is_preferred=True)])
    files = preference.elect_preferred(files)
    pick = spark.createDataFrame([("/R/GAME (JAPAN).NES", True, False)], "file_key string, manual boolean, excluded boolean")
    assert preferred(preference.set_copy_preference(files, pick)) == ["/r/Game (Japan).nes", "/r/other.nes"]
    out = spark.createDataFrame([("/R/GAME (USA).NES", False, True)], "file_key string, manual boolean, excluded boolean")
    assert preferred(preference.set_copy_preference(files, out)) == ["/r/Game (Japan).nes", "/r/other.nes"]


def test_exclude_others_and_clear(library, spark):
    files, _ = library([USA, JAPAN, dict(path="/r/gone.nes", status="Missing")])
    keys = spark.createDataFrame([("g",)], "game_key string")
    done = preference.exclude_non_preferred(preference.elect_preferred(files), keys)
    assert {r.path: r.is_excluded for r in done.collect()} == {
        "/r/Game (USA).nes": False, "/r/Game (Japan).nes": True, "/r/gone.nes": False}
    cleared = preference.clear_overrides(done, keys)
    assert cleared.filter("is_excluded").count() == 0 and preferred(cleared) == ["/r/Game (USA).nes"]


def test_views_and_summary(library, spark):
    files, games = library(
        [dict(path="/r/a.nes", size=1000, catalog_status="Verified", region="USA"), dict(path="/r/b.nes", size=2000),
         dict(path="/r/c.nes", size=5000, status="Missing"), dict(path="/r/d.nes", game="h", confidence=0.5),
         dict(path="/r/e.nes", game="i", status="Duplicate")],
        [("g", "NES", "Game", True), ("h", "NES", "Other", False), ("i", "NES", "Third", False), ("j", "NES", "Empty", False)])
    names = {view: sorted(r.game_key for r in views.view_games(games, files, view).collect()) for view in
             ("Verified", "Unverified", "ExactDuplicates", "MultipleVersions", "Missing", "NeedsReview", "Wanted", "All")}
    assert names == {"Verified": ["g"], "Unverified": ["g", "h", "i"], "ExactDuplicates": ["i"], "MultipleVersions": ["g"],
                     "Missing": ["g"], "NeedsReview": ["h"], "Wanted": ["g"], "All": ["g", "h", "i", "j"]}
    summary = {r.game_key: r for r in views.game_summary(games, files, model.builtin_systems(spark)).collect()}
    assert (summary["g"].total_size, summary["g"].file_count, summary["g"].worst_status) == (3000, 3, "Missing")
    assert (summary["j"].total_size, summary["j"].file_count, summary["j"].preferred_region) == (0, 0, None)
    assert views.library_counts(games, files).first()[:] == (4, 5, 1, 1, 1)


def test_pages(library, spark):
    files, games = library([], [(f"g{n}", "NES", f"Game {n}", False) for n in range(3)])
    systems = model.builtin_systems(spark)
    first = views.page_games(games, files, systems, 0, 2).collect()
    second = views.page_games(games, files, systems, 2, 2).collect()
    assert [r.title for r in first] == ["Game 0", "Game 1"] and all(r.has_more for r in first)
    assert [r.title for r in second] == ["Game 2"] and not second[0].has_more
    assert [r.title for r in views.page_after(games, "Game 0", "g0", 5).collect()] == ["Game 1", "Game 2"]
    for skip, take in ((-1, 1), (0, 0)):
        with pytest.raises(ValueError):
            views.page_games(games, files, systems, skip, take)


def test_search_wildcards_backslash_and_case(library):
    files, games = library([dict(path="C:\\ROMs\\A_b.nes", game="g"), dict(path="/x/Éa.nes", game="h")],
                           [("g", "NES", "Zelda", False), ("h", "NES", "100% Game", False)])
    def hits(term):
        return sorted(r.game_key for r in views.search_games(games, files, term).collect())
    assert hits("c:\\roms") == ["g"] and hits(" zELDA ") == ["g"] and hits("100%game") == ["h"]
    assert hits("éa") == [] and hits("a_b") == ["g"] and hits(" ") == ["g", "h"]


def test_merge_chain_cycle_and_self(library, spark):
    files, games = library([dict(path=f"/r/{n}.nes", game=g) for n, g in enumerate("aabcd")],
                           [(key, "NES", f"T{key}", False) for key in "abcde"])
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "d"), ("d", "nope")], "keep string, drop string")
    decisions = curation.merge_decisions(games, files, pairs)
    assert sorted(tuple(r) for r in decisions.collect()) == [("b", "a"), ("c", "a")]
    kept, moved = curation.apply_merges(games, files, decisions)
    assert sorted(r.game_key for r in kept.collect()) == ["a", "d", "e"]
    assert {r.path: r.game_key for r in moved.collect()} == {"/r/0.nes": "a", "/r/1.nes": "a", "/r/2.nes": "a",
                                                             "/r/3.nes": "a", "/r/4.nes": "d"}
    assert preferred(moved) == ["/r/0.nes"]


def test_merge_keeps_the_game_the_user_chose(library, spark):
    files, games = library([dict(path="/r/1.nes", game="a"), dict(path="/r/2.nes", game="a")],
                           [(key, "NES", f"T{key}", False) for key in "ab"])
    decisions = curation.merge_decisions(games, files, spark.createDataFrame([("b", "a")], "keep string, drop string"))
    assert [tuple(r) for r in decisions.collect()] == [("a", "b")]
    kept, moved = curation.apply_merges(games, files, decisions)
    assert [r.game_key for r in kept.collect()] == ["b"] and {r.game_key for r in moved.collect()} == {"b"}


def test_exact_titles_are_case_sensitive_and_keep_the_fullest(library, spark):
    files, games = library([dict(path="/r/1", game="b"), dict(path="/r/2", game="b"), dict(path="/r/3", game="a")],
                           [("a", "NES", "Bubsy", False), ("b", "NES", "Bubsy", False), ("c", "NES", "bubsy", False)])
    systems = model.builtin_systems(spark)
    groups = curation.exact_title_groups(games, files, systems).collect()
    assert [(g.title, g.games, g.total_files) for g in groups] == [("Bubsy", 2, 3)]
    assert [tuple(r) for r in curation.exact_title_decisions(games, files).collect()] == [("a", "b")]


def test_cleanup_needs_five_prefixed_titles(library, spark):
    numbered = ["100 Bubsy", "101 Bugs", "102 B", "103 C", "104 Captain Tsubasa 4"]
    files, games = library([dict(path="/r/v", game="v", catalog_status="Verified", catalog_name="Dragon Quest III (Japan)")],
                           [(f"n{n}", "SNES", t, False) for n, t in enumerate(numbered)]
                           + [("x", "NES", "1080 Snowboarding", False), ("y", "NES", "0002 Dragon Quest 1+2", False),
                              ("v", "NES", "dq3", False)])
    got = {r.game_key: r.suggested_title for r in curation.title_cleanup_candidates(games, files, model.builtin_systems(spark)).collect()}
    assert got == {"n0": "Bubsy", "n1": "Bugs", "n2": "B", "n3": "C", "n4": "Captain Tsubasa 4", "y": "Dragon Quest 1+2",
                   "v": "Dragon Quest III"}


def test_fuzzy_candidates_report(library, spark):
    files, games = library([dict(path="/r/1", game="a")], [("a", "NES", "Sonic the Hedgehog", False),
                                                          ("b", "NES", "Sonik the Hedgehog", False)])
    row = curation.fuzzy_candidates(games, files, model.builtin_systems(spark)).first()
    assert (row.game_a, row.game_b, row.files_a, row.files_b) == ("Sonic the Hedgehog", "Sonik the Hedgehog", 1, 0)


def test_assignment_problems(library, spark):
    files, _ = library([dict(path="/r/a.nes"), dict(path="/r/b.iso", extension=".iso", game=None)])
    wanted = spark.createDataFrame([("/R/A.NES", "PS2"), ("/R/A.NES", "NOPE"), ("/R/B.ISO", "PS2"), ("/none", "PS2"),
                                    ("/R/A.NES", "NES")], "file_key string, system_key string")
    got = {(r.file_key, r.target): r.problem for r in
           curation.assignment_problems(files, wanted, model.builtin_formats(spark)).collect()}
    assert got == {("/R/A.NES", "PS2"): "system has no format for the extension", ("/R/A.NES", "NOPE"): "system not found",
                   ("/R/B.ISO", "PS2"): "file has no game", ("/none", "PS2"): "file not in the library"}


def test_export_manifest(library, spark):
    files = spark.createDataFrame([("Sys:Tem", "/a/G.nes", "G.nes", False, 5), ("Sys:Tem", "/b/g.nes", "g.nes", False, 7),
                                   ("NES", "/a/H.nes", "H.nes", False, 9)],
                                  "system_name string, path string, file_name string, is_directory boolean, size long")
    there = spark.createDataFrame([("NES/H.nes", 9), ("Sys_Tem/G.nes", 4)], "target string, size long")
    manifest = sinks.export_manifest(files, there)
    got = {r.path: (r.target, r.action, r.collides) for r in manifest.collect()}
    assert got == {"/a/G.nes": ("Sys_Tem/G.nes", "copy", True), "/b/g.nes": ("Sys_Tem/g.nes", "copy", True),
                   "/a/H.nes": ("NES/H.nes", "skip", False)}
    assert sinks.export_counts(manifest).first()[:] == (2, 1, 2)


def test_csv_quotes_everything(library, spark, tmp_path):
    rows = spark.createDataFrame([("AB", "S", 'say "hi", ok', "f", "p\nq", 3)],
                                 "sha256 string, system string, game_title string, file_name string, path string, size long")
    sinks.write_duplicate_csv(rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines()[0] == '"SHA-256","System","Game Title","File Name","Full Path","Size Bytes"'
    assert '"AB","S","say ""hi"", ok","f","p' in text and text.rstrip().endswith('"3"')
    assert sinks.read_report_csv(spark, str(tmp_path / "out")).first()["Full Path"] == "p\nq"


def _names_shuffled(frame, name):
    """Whether a column of files is dealt out in any exchange of a plan."""
    stack, hit = [frame._jdf.queryExecution().executedPlan().initialPlan()], False
    while stack:
        node = stack.pop()
        if node.nodeName() == "Exchange":
            hit = hit or any(node.output().apply(n).name() == name for n in range(node.output().size()))
        stack += [node.children().apply(n) for n in range(node.children().size())]
    return hit


def test_what_only_a_score_reads_does_not_travel(spark):
    """The names a score is worked out from stay where they are; in the old plans they went through each join."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.range(40).selectExpr(
            "CAST(id AS STRING) AS file_key", "concat('/r/', id) AS path", "concat(id, ' (USA).nes') AS file_name", "'.nes' AS extension",
            "id % 7 AS game_key", "CASE WHEN id % 3 = 0 THEN 'Disc 1' END AS file_group", "'Normal' AS status", "'Unknown' AS catalog_status",
            "CAST(NULL AS STRING) AS catalog_name", "'' AS revision", "id % 5 = 0 AS is_preferred", "id % 4 = 0 AS is_manual",
            "id % 6 = 0 AS is_excluded", "7 AS preference_score")
        keys = spark.range(3).selectExpr("id AS game_key")
        overrides = spark.range(5).selectExpr("CAST(id AS STRING) AS file_key", "id % 2 = 0 AS manual", "id % 2 = 1 AS excluded")
        games = spark.range(7).selectExpr("id AS game_key")
        decisions = spark.createDataFrame([(1, 0), (2, 0), (5, 4)], "game_key long, keep_key long")
        for done in (preference.exclude_non_preferred(files, keys), preference.clear_overrides(files, keys),
                     preference.set_copy_preference(files, overrides), curation.apply_merges(games, files, decisions)[1]):
            flags = done.select("file_key", "game_key", "is_preferred", "is_manual", "is_excluded", "preference_score")
            assert flags.count() == 40
            assert not _names_shuffled(flags, "file_name") and not _names_shuffled(flags, "catalog_name")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_a_compressed_report_reads_back_the_same(spark, tmp_path):
    rows = spark.range(200).select(F.lit("AB").alias("sha256"), F.lit('S "q", r').alias("system"),
                                   F.concat(F.lit("Title "), F.col("id").cast("string")).alias("game_title"),
                                   F.concat(F.col("id").cast("string"), F.lit(".nes")).alias("file_name"), F.lit("/r").alias("path"), F.col("id").alias("size"))
    sinks.write_duplicate_csv(rows, str(tmp_path / "plain"))
    sinks.write_duplicate_csv(rows, str(tmp_path / "small"), "gzip")
    plain, small = (sorted(map(tuple, sinks.read_report_csv(spark, str(tmp_path / n)).collect())) for n in ("plain", "small"))
    assert plain == small and len(plain) == 200
    size = {n: sum(p.stat().st_size for p in (tmp_path / n).glob("part-*")) for n in ("plain", "small")}
    assert size["small"] < size["plain"] / 2 and all(p.suffix == ".gz" for p in (tmp_path / "small").glob("part-*"))


def test_a_manual_file_without_a_key_keeps_its_score(spark, library):
    files, _ = library([dict(path="/r/a.nes"), dict(path="/r/b.nes", is_manual=True)])
    files = files.withColumn("file_key", F.when(F.col("path") == "/r/a.nes", F.col("file_key")))
    overrides = spark.createDataFrame([("/R/A.NES", True, False)], "file_key string, manual boolean, excluded boolean")
    rows = {r.path: r for r in preference.set_copy_preference(files, overrides).collect()}
    assert rows["/r/b.nes"].is_manual and rows["/r/a.nes"].preference_score == rows["/r/b.nes"].preference_score


ODD_TEXTS = ["plain", "", None, "a\x01b", "\x02", "ünï", "x" * 70_000]
ODD_HASHES = ["AB" * 32, "ab" * 32, "aB" * 32, "12" * 32, "ab" * 20, "CD" * 20, "abc", "", "no hash", None]


def _report_before(files, games, systems, hashes):
    """The report as it was written down first: whole rows joined and sorted as they are."""
    def stored(algorithm):
        return F.max(F.when(F.col("algorithm") == algorithm, F.col("hash")))
    pivot = (hashes.filter(F.col("algorithm").isin("SHA256", "SHA1")).groupBy("file_key")
             .agg(stored("SHA256").alias("sha256"), stored("SHA1").alias("sha1")))
    owners = games.select("game_key", "system_key", "title", "sort_title").join(systems.select("system_key", "system_name"), "system_key").drop("system_key")
    joined = files.join(owners, "game_key", "left").join(pivot, "file_key", "left")
    return (joined.orderBy(F.asc_nulls_first("system_name"), F.asc_nulls_first("sort_title"), "file_name", "file_key")
            .select(F.coalesce("system_name", F.lit("")).alias("system"), F.coalesce("title", F.lit("")).alias("game_title"), "file_name", "path",
                    F.col("location").alias("source_folder"), F.coalesce("format_name", F.lit("")).alias("format"), "size", "modified", "region",
                    "language", "revision", "version", "status", "catalog_status", "catalog_source", "catalog_name", "is_preferred", "is_manual",
                    "is_excluded", "preference_score", "quick_hash", "sha256", "sha1"))


def _odd_report(spark, kind):
    rng = random.Random(4)
    pick = rng.choice
    times = ["1999-12-31 23:59:59", "2024-02-29 12:00:00.000001", "1969-12-31 23:59:59", "2200-01-01 00:00:00", None]
    texts = ["location", "region", "language", "revision", "version", "format_name", "status", "catalog_status", "catalog_source", "catalog_name", "quick_hash"]
    rows = []
    for n in range(400):
        path = pick([f"/r/{n}/Gäme {n}.nes", f"/r/{n}", f"{n}", f"/r/\x01{n}/b\x02", "/r/" + "p" * 66_000 + str(n), f"/r/twice{n % 7}"])
        odd = n % 2
        rows.append((pick([path.upper(), path.upper(), None, path]) if odd else path.upper(), path if n % 50 else None,
                     pick([path.rsplit("/", 1)[-1], "other", None]) if odd else path.rsplit("/", 1)[-1], pick([1, 2, 3, 4, 5, 9, None]),
                     pick([0, 5, 2**31 - 1, 2**31, 2**40, -1, None]) if odd else n, pick(times) if odd else times[0],
                     *[pick([True, False, None] if odd else [True, False]) for _ in range(3)], pick([n, None]),
                     *[pick(["/r", "/r/", *ODD_TEXTS]) if odd else pick(["/r", "x", "", None]) for _ in texts]))
    files = spark.createDataFrame(rows, "file_key string, path string, file_name string, game_key long, size long, modified string, is_preferred boolean, "
                                        "is_manual boolean, is_excluded boolean, preference_score int, " + ", ".join(f"{t} string" for t in texts))
    files = files.withColumn("modified", F.col("modified").cast(kind))
    games = spark.createDataFrame([(1, "A", "The One", "One, The"), (2, "A", "Two", "Two"), (3, "B", "T" * 5000, "T" * 5000), (4, "B", None, None),
                                   (5, "gone", "x", "x"), (2, "B", "Zwei", ""), (None, "A", "n", "n")], "game_key long, system_key string, title string, sort_title string")
    systems = spark.createDataFrame([("A", "System A"), ("B", None), ("B", "s" * 300)], "system_key string, system_name string")
    keys = [row[0] for row in rows if row[0]]
    hashes = spark.createDataFrame([(pick([*keys, None]), pick(["SHA256", "SHA1", "CRC32"]), pick(ODD_HASHES)) for _ in range(1500)],
                                   "file_key string, algorithm string, hash string")
    return files, games, systems, hashes


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_a_packed_inventory_equals_whole_rows(spark, kind):
    tables = _odd_report(spark, kind)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got, want = views.inventory_rows(*tables), _report_before(*tables)
        assert got.dtypes == want.dtypes
        got, want = got.collect(), want.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 400
    order = ["system", "file_name"]
    assert [tuple(r[n] for n in order) for r in got] == [tuple(r[n] for n in order) for r in want]
    assert sum(r.sha256 is not None for r in got) > 50 and sum(r.sha1 is not None for r in got) > 50


def test_an_inventory_moves_few_bytes(spark):
    files, games, systems, hashes = _odd_report(spark, "timestamp")
    # A usual row travels as a number and bytes; neither key nor name nor a hash as text.
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = views.inventory_rows(files, games, systems, hashes)
        assert not _names_shuffled(rows, "quick_hash") and not _names_shuffled(rows, "hash")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def _odd_files(spark):
    rng = random.Random(9)
    pick = rng.choice
    rows = []
    for n in range(300):
        path = pick([f"/r/Game {n} (USA).nes", f"/r/ünï {n}.zip", f"/r/twice {n % 5}", None])
        rows.append((pick([path and path.upper(), path and path.upper(), path, None, f"k{n}"]), pick([f"g{n % 40}"] * 5 + [None, "hot"]), path, pick(["a (Japan)", "b"]),
                     pick([".nes", ".zip", None]), 1, pick(["Normal", "Missing", "Duplicate", None]), pick(["Verified", "Unknown"]), pick([None, "x (USA)"]),
                     pick([None, "Rev 1"]), pick([None, None, "Disc 1", "Disc 2"]), *[pick([True, False, False, None]) for _ in range(3)], 0.5, "", False, pick([n, None])))
    return spark.createDataFrame(rows, FILE + ", preference_score int")


def test_copy_preference_equals_its_steps_one_by_one(spark):
    files = _odd_files(spark)
    keys = sorted({r.file_key for r in files.collect() if r.file_key})
    rng = random.Random(1)
    named = [(key, manual, not manual) for key in rng.sample(keys, 60) for manual in [rng.random() < 0.6]] + [("unknown", True, False), (None, True, False)]
    overrides = spark.createDataFrame(named, "file_key string, manual boolean, excluded boolean")
    got = preference.set_copy_preference(files, overrides)
    met = files.join(overrides, "file_key", "left").withColumn("hit", F.col("manual").isNotNull())
    chosen = met.filter("hit AND game_key IS NOT NULL").groupBy("game_key").agg(F.max(F.when(F.col("manual"), F.col("file_key"))).alias("chosen"))
    changed = met.withColumn("is_preferred", F.expr("CASE WHEN hit AND excluded THEN false ELSE is_preferred END")).withColumn(
        "is_excluded", F.expr("CASE WHEN hit THEN excluded ELSE is_excluded END")).withColumn(
        "is_manual", F.expr("CASE WHEN hit AND excluded THEN false WHEN hit THEN manual ELSE is_manual END"))
    redo = changed.join(chosen, "game_key").withColumn("is_manual", F.expr("CASE WHEN chosen <> file_key THEN false ELSE is_manual END"))
    rest = changed.join(chosen, "game_key", "left_anti")
    want = preference.elect_preferred(redo.select(files.columns)).select(files.columns).unionByName(rest.select(files.columns))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert rest.count() > 50 and redo.count() > 50
    without = preference.set_copy_preference(files.drop("preference_score"), overrides)
    assert without.columns == [*files.drop("preference_score").columns, "preference_score"]
    assert without.filter("preference_score IS NULL").count() == 0


def _exchanges(frame):
    stack, found = [frame._jdf.queryExecution().executedPlan().initialPlan()], []
    while stack:
        node = stack.pop()
        found += [node] if node.nodeName() == "Exchange" else []
        stack += [node.children().apply(n) for n in range(node.children().size())]
    return found


def test_one_exchange_serves_the_pick_and_the_result(spark):
    """Files meet their games once: the exchanges that carry their paths to the games are the same, so Spark runs one."""
    overrides = spark.createDataFrame([("a", True, False)], "file_key string, manual boolean, excluded boolean")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        done = preference.set_copy_preference(_odd_files(spark).drop("preference_score"), overrides)
        flags = done.select("file_key", "game_key", "is_preferred", "is_manual", "is_excluded", "preference_score")
        columns = [[(e, e.output().apply(n).name()) for n in range(e.output().size())] for e in _exchanges(flags)]
        home = [row[0][0] for row in columns if {"path", "game_key", "__flags"} <= {name for _, name in row}]
        assert len(home) == 2 and home[0].canonicalized().equals(home[1].canonicalized())
        assert not any({"path", "file_key"} <= {name for _, name in row} for row in columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
