import pytest

from shelfmark import model
from shelfmark.operators import identify

DISC_SYSTEMS = ["SATURN", "SEGACD", "3DO", "DREAMCAST", "JAGCD", "PCECD", "NEOGEOCD", "CDI", "CD32", "FMTOWNS"]


@pytest.fixture(scope="module")
def found(spark):
    paths = [("D:/ROMs/PS2/Game.iso", ".iso"), ("D:\\Games\\Roms\\PS3_Games\\Some Game (USA).iso", ".iso"),
             ("D:/Games/MAGIC_Collection/Some Game.iso", ".iso"), ("D:/PS3_Games/BLUS30057-[Army of Two TM]", ".ps3dir"),
             ("D:/x/a.zip", ".zip"), ("D:/x/a.NES", "NES"), ("D:/x/a.txt", ".txt")]
    paths += [(f"D:/ROMs/{key}/Game (Track 1).bin", ".bin") for key in DISC_SYSTEMS]
    rows = spark.createDataFrame(paths, "path string, extension string")
    return {row.path: row for row in identify.identify_format(rows, model.builtin_formats(spark)).collect()}


def test_table_sizes():
    systems, formats = model.platform_rows()
    assert (len(systems), len(formats), len({row[4] for row in formats}), len(model.catalog_sources())) == (61, 137, 81, 46)


def test_folder_hint_decides_an_ambiguous_extension(found):
    row = found["D:/ROMs/PS2/Game.iso"]
    assert (row.system_key, row.confidence) == ("PS2", 0.8)


def test_key_as_token_not_as_substring(found):
    assert found["D:\\Games\\Roms\\PS3_Games\\Some Game (USA).iso"].system_key == "PS3"
    assert found["D:/Games/MAGIC_Collection/Some Game.iso"].system_key != "GC"


def test_package_folder(found):
    row = found["D:/PS3_Games/BLUS30057-[Army of Two TM]"]
    assert (row.system_key, row.format_type, row.confidence) == ("PS3", "DirectoryGame", 0.95)


def test_unhinted_archive_and_single_candidate_and_unknown(found):
    assert (found["D:/x/a.zip"].system_key, found["D:/x/a.zip"].confidence) == ("MAME", 0.8)
    assert (found["D:/x/a.NES"].system_key, found["D:/x/a.NES"].confidence) == ("NES", 0.95)
    assert (found["D:/x/a.txt"].system_key, found["D:/x/a.txt"].reason) == (None, "Unsupported extension")


@pytest.mark.parametrize("key", DISC_SYSTEMS)
def test_track_files_of_every_disc_system(found, key):
    row = found[f"D:/ROMs/{key}/Game (Track 1).bin"]
    assert (row.system_key, row.format_type) == (key, "DiscImage")


def test_tie_takes_the_first_platform(spark):
    rows = spark.createDataFrame([("/a/b.cue", ".cue"), ("/a/b.rvz", ".rvz")], "path string, extension string")
    formats = model.builtin_formats(spark).filter("system_key in ('SATURN', 'SEGACD')")
    got = {r.path: r for r in identify.identify_format(rows, formats).collect()}
    assert (got["/a/b.cue"].system_key, got["/a/b.cue"].confidence) == ("SATURN", 0.5)


def test_archive_takes_its_best_entry(spark):
    rows = spark.createDataFrame([("/a/x.zip", ".zip"), ("/a/y.zip", ".zip")], "path string, extension string")
    entries = spark.createDataFrame([("/a/x.zip", 0, "read.txt"), ("/a/x.zip", 1, "g.iso"), ("/a/x.zip", 2, "d/g.nes")],
                                    "archive_path string, position long, entry_name string")
    got = {r.path: r for r in identify.identify_with_archives(rows, entries, model.builtin_formats(spark)).collect()}
    assert (got["/a/x.zip"].system_key, got["/a/x.zip"].confidence) == ("NES", 0.98)
    assert got["/a/x.zip"].reason == "ZIP archive contains a recognized Nintendo Entertainment System file"
    assert got["/a/y.zip"].system_key == "MAME"
