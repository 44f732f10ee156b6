from pyspark.sql import functions as F

from shelfmark.functions import hashing, text
from shelfmark.functions.scoring import preference_score
from shelfmark.operators import resolve


def parse(spark, *names):
    rows = spark.createDataFrame([(n, name, "SNES") for n, name in enumerate(names)], "n int, file_name string, system_key string")
    return resolve.parse_titles(rows).orderBy("n").collect()


def test_region_revision_and_tag(spark):
    row, = parse(spark, "Super Mario World (USA) (Rev 1) [!].sfc")
    assert (row.title, row.region, row.revision, row.tags) == ("Super Mario World", "USA", "Rev 1", ["!"])


def test_lists_keep_order_and_drop_repeats(spark):
    row, = parse(spark, "Pokemon Emerald (USA, Europe, USA) (En,Ja,en).gba")
    assert (row.region, row.language) == ("USA, Europe", "English, Japanese")


def test_disc_and_track(spark):
    rows = parse(spark, "Final Fantasy VII (Disc 2).cue", "Metal Gear Solid CD1.bin", "A (Track 07).bin", "B (Disc 99999999999).bin")
    assert [row.disc_number for row in rows] == [2, 1, None, None]
    assert rows[2].track_number == 7


def test_last_revision_and_version_win(spark):
    row, = parse(spark, "X (Rev 1) (Rev 2) (v1.0) (Version 2.b).md")
    assert (row.revision, row.version) == ("Rev 2", "Version 2.b")


def test_blank_title_falls_back_to_stem_and_dots_are_lost(spark):
    rows = parse(spark, "(USA) [b].nes", "Folder v1.2 name", "under_score - .zip")
    assert [row.title for row in rows] == ["(USA) [b]", "Folder v1", "under score"]
    assert rows[0].normalised_title == "usab"


def test_same_game_across_regions_not_across_systems(spark):
    a, b = parse(spark, "Super Mario World (USA).sfc", "Super Mario World (Japan) (Rev 1).smc")
    assert a.game_key == b.game_key == "SNES:supermarioworld"


def test_normalise_title(texts):
    got = texts(["Pokémon", "ΑΣ", "ポケ", "ガ", "１２ Ａ", "각", "a😀b", "--", "ﬁ", "Æon İ"], text.normalise_title)
    assert got[0] == "pokemon"
    assert got[1] == "ας".replace("ς", "σ")
    assert got[3] == "カ"
    assert got[4] == "１２ａ"
    assert got[5] == "\u1100\u1161\u11a8"
    assert got[6:8] == ["ab", ""]
    assert got[9] == "æoni"


def test_rank_prefixes(texts):
    titles = ["0002 Dragon Quest 1+2", "001 - Super Mario Bros. 3", "1080 Snowboarding", "Chrono Trigger", "0002 -   ",
              "64 de Hakken!!"]
    assert texts(titles, text.strip_rank_prefix) == ["Dragon Quest 1+2", "Super Mario Bros. 3", None, None, None, None]
    assert texts(titles, text.strip_any_number_prefix) == [
        "Dragon Quest 1+2", "Super Mario Bros. 3", "Snowboarding", None, None, "de Hakken!!"]


def test_trailing_tags(texts):
    titles = ["Dragon Quest III (Japan) (Rev 1)", "Sonic the Hedgehog [Proto]", "Chrono Trigger", "(A) (B)", "(A)"]
    assert texts(titles, text.strip_trailing_tags) == [
        "Dragon Quest III", "Sonic the Hedgehog", "Chrono Trigger", "(A)", "(A)"]


def test_sort_title_folder_and_artwork(spark, texts):
    assert texts(["The Game", "THE X", "Theme"], text.sort_title) == ["Game, The", "X, The", "Theme"]
    assert texts(["Sys:Tem*Name", "a/b\\c\x01"], text.sanitise_folder) == ["Sys_Tem_Name", "a_b_c_"]
    rows = spark.createDataFrame([("A & B", "t", "USA"), (None, "T", "USA, Europe"), (" ", "T", ""), (None, " ", "x")],
                                 "c string, t string, r string")
    got = [r[0] for r in rows.select(text.artwork_key(F.col("c"), F.col("t"), F.col("r"))).collect()]
    assert got == ["A _ B", "T (USA)", "T", None]


def test_similarity_bucket_numbers(spark, texts):
    pair = spark.createDataFrame([("sonic the hedgehog", "sonik the hedgehog"), ("", "")], "a string, b string")
    got = [r[0] for r in pair.select(text.title_similarity(F.col("a"), F.col("b"))).collect()]
    assert 0.9 < got[0] < 1 and got[1] == 1.0
    assert texts(["sonic", ""], text.fuzzy_bucket) == ["s-1", ""]
    assert texts(["a12b3"], text.title_numbers) == [["12", "3"]]


def test_hashes_and_headers(spark):
    import hashlib
    import zlib
    body = bytes(range(256)) * 20
    row = spark.createDataFrame([(bytearray(body),)], "c binary").select(
        hashing.quick_hash(F.col("c"), F.length("c").cast("long"), 1000).alias("q"),
        hashing.quick_hash(F.col("c"), F.length("c").cast("long"), 10000).alias("small"),
        hashing.crc32_hex(F.col("c")).alias("crc"), hashing.sha1_hex(hashing.payload(F.col("c"), F.lit(16))).alias("body")).first()
    size = str(len(body)).encode()
    assert row.q == hashlib.sha256(size + body[:1000] + body[-1000:]).hexdigest().upper()
    assert row.small == hashlib.sha256(size + body).hexdigest().upper()
    assert row.crc == f"{zlib.crc32(body):08X}"
    assert row.body == hashlib.sha1(body[16:]).hexdigest().upper()
    cases = [("NES", ".nes", 8192 + 16, 16), ("nes", ".NES", 8192 + 16, 16), ("NES", ".nes", 8192, 0), ("NES", ".nes", 16, 0),
             ("FDS", ".fds", 65500 + 16, 16), ("SNES", ".x", 1024 + 512, 512), ("SNES", ".sfc", 512, 0), ("GB", ".gb", 1536, 0)]
    rows = spark.createDataFrame(cases, "s string, e string, n long, want int")
    assert rows.filter(hashing.header_skip(F.col("s"), F.col("e"), F.col("n")) != F.col("want")).count() == 0


def test_preference_scores(spark):
    columns = "name string, catalog string, status string, verified string, rev string, ext string, manual boolean, excluded boolean"
    cases = [("A (USA).nes", None, "Normal", "Unknown", None, ".nes", False, False, 120),
             ("A (usa).zip", None, "Normal", "Unknown", "Rev 1", ".ZIP", False, False, 135),
             ("A (USA, Europe).nes", None, "Normal", "Unknown", " ", ".nes", False, False, 0),
             ("A (Europe) (Japan)", None, "Normal", "Verified", None, "", False, False, 1080),
             ("x (USA)", "A (Japan) (Beta 2)", "Normal", "Verified", None, "", True, False, 4740),
             ("A [b1] (Hack)", None, "Corrupt", "Unknown", None, "", False, False, -1300),
             ("A (USA)", None, "Missing", "Verified", None, "", True, False, -10000),
             ("A (USA)", None, "Normal", "Verified", None, "", True, True, -10000)]
    rows = spark.createDataFrame(cases, columns + ", want int")
    score = preference_score(status=F.col("status"), catalog_status=F.col("verified"), catalog_name=F.col("catalog"),
                             file_name=F.col("name"), revision=F.col("rev"), extension=F.col("ext"),
                             excluded=F.col("excluded"), manual=F.col("manual"))
    assert [r for r in rows.withColumn("got", score).collect() if r.got != r.want] == []
