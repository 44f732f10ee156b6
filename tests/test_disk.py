"""Sources that read files, and the whole scan and verification jobs over a small tree."""

import hashlib
import struct
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark import model
from shelfmark.operators import duplicates, reconcile
from shelfmark.plans.scan_job import Library, scan, supported_flags
from shelfmark.plans.verify_job import verify
from shelfmark.sources import catalogs, listing, sinks


def package_file(title=b"Army of Two\0", key=b"TITLE", magic=b"\0PSF", kind=0x0204):
    head = magic + struct.pack("<IIII", 0x101, 36, 36 + len(key) + 3, 1)
    return head + struct.pack("<HHIII", 0, kind, len(title), 64, 0) + key + b"\0\0\0" + title


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "lib"
    for folder in ("NES", "SNES", "PS3/BLUS1/USRDIR", "PS3/Two/PS3_GAME", "PS3/Two/deep/PS3_GAME"):
        (root / folder).mkdir(parents=True)
    (root / "NES/Game (USA).nes").write_bytes(b"same bytes")
    (root / "NES/Copy (Japan).nes").write_bytes(b"same bytes")
    (root / "NES/Other.NES").write_bytes(b"othr bytes")
    (root / "NES/notes.txt").write_bytes(b"x")
    (root / "NES/Big (Disc 1).cue").write_bytes(b"cue")
    with zipfile.ZipFile(root / "SNES/Packed.zip", "w") as archive:
        archive.writestr("Packed (Europe).sfc", b"snes payload")
    (root / "SNES/broken.zip").write_bytes(b"PK\3\4")
    (root / "PS3/BLUS1/PARAM.SFO").write_bytes(package_file())
    (root / "PS3/BLUS1/USRDIR/EBOOT.BIN").write_bytes(b"12345")
    (root / "PS3/Two/PS3_GAME/PARAM.SFO").write_bytes(package_file(b"Two Worlds (Rev 1)\0\0"))
    (root / "PS3/Two/deep/PS3_GAME/PARAM.SFO").write_bytes(package_file())
    (root / "PS3/loose.iso").write_bytes(b"iso")
    return root


def test_package_metadata(spark):
    cases = [package_file(), package_file(key=b"SUBTI"), package_file(magic=b"\0PSG"), package_file()[:10],
             package_file(b" \0"), package_file(kind=0x0404), b""]
    rows = spark.createDataFrame([(str(n), bytearray(c)) for n, c in enumerate(cases)], "path string, content binary")
    got = {r.marker_path: r.package_title for r in listing.package_titles(rows).collect()}
    assert got == {"0": "Army of Two", **{str(n): None for n in range(1, 7)}}


def test_listing_packages_and_recursion(spark, tree):
    rows = listing.list_files(spark, str(tree))
    assert {r.file_name: r.extension for r in rows.filter("path like '%/NES/%'").collect()}["Other.NES"] == ".nes"
    packed = {r.file_name: r for r in reconcile.collapse_packages(rows).collect()}
    assert (packed["BLUS1"].extension, packed["BLUS1"].size) == (".ps3dir", len(package_file()) + 5)
    assert packed["Two"].is_directory and packed["Two"].marker_path.endswith("/Two/PS3_GAME/PARAM.SFO")
    assert "EBOOT.BIN" not in packed and "deep" not in packed and "loose.iso" in packed
    flat = listing.list_files(spark, str(tree / "SNES"), recursive=False)
    assert sorted(r.file_name for r in flat.collect()) == ["Packed.zip", "broken.zip"]


def test_path_clashes_are_reported(spark):
    rows = spark.createDataFrame([("/a/B", 1), ("/a/b", 2), ("/c", 3)], "path string, size long")
    assert [(r.file_key, r.paths) for r in reconcile.path_clashes(rows).collect()] == [("/A/B", 2)]
    assert {r.path for r in reconcile.with_file_key(rows).collect()} == {"/a/B", "/c"}


def test_quick_and_full_hashes_of_files(spark, tmp_path):
    big = tmp_path / "big.bin"
    body = bytes(range(251)) * 1000
    big.write_bytes(body)
    paths = spark.createDataFrame([(str(big), len(body))], "path string, size long")
    quick = listing.quick_hash_files(paths).first().quick_hash
    want = hashlib.sha256(str(len(body)).encode() + body[:65536] + body[-65536:]).hexdigest().upper()
    assert quick == want
    held = listing.quick_hash_contents(listing.read_contents(spark, str(tmp_path))).first().quick_hash
    assert held == want
    assert listing.sha256_files(paths).first().sha256 == hashlib.sha256(body).hexdigest().upper()


def runs(spark, root, when, complete=True):
    return spark.createDataFrame([(str(root), datetime.fromisoformat(when), complete)],
                                 "location string, started timestamp, complete boolean")


def empty_library(spark):
    kinds = {"size": "long", "created": "timestamp", "modified": "timestamp", "disc_number": "int", "track_number": "int",
             "is_directory": "boolean", "confidence": "double", "catalog_verified_at": "timestamp", "is_preferred": "boolean",
             "is_manual": "boolean", "is_excluded": "boolean", "preference_score": "int", "is_detection_manual": "boolean",
             "last_seen": "timestamp"}
    files = spark.createDataFrame([], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in reconcile.FILE_COLUMNS))
    games = spark.createDataFrame([], "game_key string, system_key string, title string, sort_title string, "
                                      "normalised_title string, is_wanted boolean")
    return Library(files, games, spark.createDataFrame([], "file_key string, algorithm string, hash string"))


def stored(spark, library, base):
    for name in ("files", "games", "hashes"):
        sinks.write_version(getattr(library, name), f"{base}/{name}", 1)
    return Library(*[sinks.read_version(spark, f"{base}/{name}", 1) for name in ("files", "games", "hashes")])


def full_scan(spark, library, root, when, complete=True):
    rows = reconcile.collapse_packages(listing.list_files(spark, str(root)))
    archives = listing.read_contents(spark, str(root), "*.zip")
    return rows, scan(library, rows, model.builtin_formats(spark), runs(spark, root, when, complete),
                      entries=listing.list_archive_entries(archives), titles=listing.read_package_titles(spark, str(root)))


def test_scan_rescan_and_verify(spark, tree, tmp_path):
    rows, (first, diff) = full_scan(spark, empty_library(spark), tree, "2030-01-01")
    flags = supported_flags(rows, model.builtin_formats(spark))
    counts = reconcile.scan_counters(diff, flags).first()
    assert (counts.discovered, counts.added, counts.unsupported, counts.missing) == (10, 9, 1, 0)
    first = stored(spark, first, tmp_path / "v1")
    files = {r.file_name: r for r in first.files.collect()}
    assert len(files) == 9 and "notes.txt" not in files
    assert (files["BLUS1"].system_key, files["BLUS1"].game_key) == ("PS3", "PS3:armyoftwo")
    assert files["BLUS1"].quick_hash == "paramsfo:" + hashlib.sha256(package_file()).hexdigest().upper()
    assert (files["Two"].revision, files["Two"].game_key) == ("Rev 1", "PS3:twoworlds")
    assert (files["Packed.zip"].system_key, round(files["Packed.zip"].confidence, 2)) == ("SNES", 0.98)
    assert files["broken.zip"].system_key == "MAME" or files["broken.zip"].confidence <= 0.8
    assert files["Big (Disc 1).cue"].file_group == "1|Disc 1"
    assert {n: files[n].status for n in ("Game (USA).nes", "Copy (Japan).nes", "Other.NES")} == {
        "Game (USA).nes": "Duplicate", "Copy (Japan).nes": "Duplicate", "Other.NES": "Normal"}
    assert {r.file_key for r in first.hashes.collect()} == {files["Game (USA).nes"].file_key, files["Copy (Japan).nes"].file_key}
    report = duplicates.duplicate_report(first.files, first.games, first.hashes, model.builtin_systems(spark))
    assert duplicates.duplicate_groups(report).first()[:] == (2, 1, 10)

    # One file changes, one vanishes, one arrives; the rest is touched.
    (tree / "NES/Other.NES").write_bytes(b"other bytes, longer")
    (tree / "PS3/loose.iso").rename(tree / "PS3/loose2.iso")
    _, (second, diff) = full_scan(spark, first, tree, "2031-01-01")
    changes = {r.file_key.rsplit("/", 1)[-1]: r.change for r in diff.collect()}
    assert (changes["OTHER.NES"], changes["LOOSE.ISO"], changes["LOOSE2.ISO"]) == ("changed", "unseen", "added")
    assert changes["GAME (USA).NES"] == "unchanged"
    after = {r.file_name: r for r in second.files.collect()}
    assert after["loose.iso"].status == "Missing" and after["Game (USA).nes"].status == "Duplicate"
    # An incomplete run marks nothing missing.
    (tree / "NES/Other.NES").rename(tree / "NES/Another.NES")
    _, (third, _) = full_scan(spark, first, tree, "2031-01-01", complete=False)
    assert {r.status for r in third.files.filter("file_name in ('loose.iso', 'Other.NES')").collect()} == {"Normal"}

    # Verification: by SHA-1, by an archive member's CRC, and by nothing.
    packed = b"snes payload"
    entries = spark.createDataFrame(
        [("NES", "c", 1, "Game (USA)", "g", 0, None, hashlib.sha1(b"same bytes").hexdigest().upper()),
         ("SNES", "c", 1, "Packed (Europe)", "p", len(packed), f"{zlib.crc32(packed):08X}", None)],
        "system_key string, source_file string, position long, name string, rom_name string, size long, crc32 string, sha1 string")
    done, updates = verify(first, entries, model.builtin_catalog_sources(spark), F.lit("2032-01-01").cast("timestamp"))
    got = {r.file_key.rsplit("/", 1)[-1]: (r.catalog_status, r.catalog_name) for r in updates.collect()}
    assert got["GAME (USA).NES"] == got["COPY (JAPAN).NES"] == ("Verified", "Game (USA)")
    assert got["PACKED.ZIP"] == ("Verified", "Packed (Europe)")
    assert got["BLUS1"] == ("Unsupported", None) and got["BIG (DISC 1).CUE"][0] == "Error"
    assert got["OTHER.NES"][0] == "Error"  # renamed away above: it cannot be read
    assert done.hashes.filter("algorithm = 'SHA1'").count() == 3
    verified = done.files.filter("catalog_status = 'Verified'")
    assert verified.filter("catalog_verified_at is null or catalog_source not like 'Libretro%'").count() == 0


def test_archives(spark, tree):
    rows = listing.read_contents(spark, str(tree), "*.zip")
    got = [(r.archive_path.rsplit("/", 1)[-1], r.position, r.entry_name, r.entry_size)
           for r in listing.list_archive_entries(rows).collect()]
    assert got == [("Packed.zip", 0, "Packed (Europe).sfc", 12)]
    held = listing.read_archive_members(rows.withColumn("file_key", F.col("path")).withColumn("system_key", F.lit("SNES")))
    assert [(r.extension, bytes(r.content)) for r in held.collect()] == [(".sfc", b"snes payload")]


def test_unreadable_archives_are_errors_and_large_members_stream(spark, tmp_path):
    import hashlib
    import zipfile

    body = b"0123456789abcdef" * 200_000
    with zipfile.ZipFile(tmp_path / "good.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("Big Game (Test).gba", body)
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 no archive")
    rows = spark.createDataFrame([(n, "GBA", str(tmp_path / f"{n}.zip")) for n in ("good", "broken", "gone")],
                                 "file_key string, system_key string, path string")
    hashed = {r.file_key: r for r in listing.hash_archive_members(rows).collect()}
    assert hashed["good"].sha1 == hashlib.sha1(body).hexdigest().upper() and not hashed["good"].failed
    assert hashed["broken"].failed and hashed["gone"].failed
    candidates = spark.createDataFrame([(n, "GBA", False, e) for n, e in
                                        (("good", ".zip"), ("broken", ".zip"), ("gone", ".zip"), ("other", ".7z"))],
                                       "file_key string, system_key string, is_directory boolean, extension string")
    entries = spark.createDataFrame([("GBA", "Big Game", "x.gba", len(body), None, hashed["good"].sha1, "s", 0)],
                                    "system_key string, name string, rom_name string, size long, crc32 string, sha1 string, "
                                    "source_file string, position long")
    members = listing.hash_archive_members(rows)
    plain = listing.hash_files(spark.createDataFrame([], "file_key string, system_key string, extension string, path string, size long"))
    from shelfmark.operators import verification
    got = verification.verify_catalog(candidates, plain, entries, model.builtin_catalog_sources(spark),
                                      members.filter("NOT failed"), failures=members.filter("failed"))
    assert {r.file_key: r.catalog_status for r in got.collect()} == {
        "good": "Verified", "broken": "Error", "gone": "Error", "other": "Unsupported"}


def test_content_stages_are_sized_by_bytes_and_refuse_unknown_stores(spark):
    rows = spark.createDataFrame([(f"/x/{n}", 1 << 28) for n in range(40)], "path string, size long")
    assert listing.spread_by_bytes(rows).rdd.getNumPartitions() == 10
    assert listing.local_path("file:/a/b") == listing.local_path("file:///a/b") == "/a/b"
    with pytest.raises(ValueError):
        listing.local_path("s3a://bucket/key")


def test_report_times_are_utc_in_any_session_zone(spark):
    from shelfmark.sources import sinks
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = sinks._report_text(spark.sql("SELECT timestamp_seconds(0) AS at, TIMESTAMP_NTZ '1970-01-01 00:00:00' AS plain")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert row.at == row.plain == "1970-01-01T00:00:00.0000000Z"


TEXT_CATALOG = '''clrmamepro ( name "Test" game ignored )
game (
    name "Lantern Drift (Test)"
    rom ( name "LanternDrift.a26" size 5120 crc 00c0ffee md5 77aa sha1 5eed5eed00112233445566778899aabbccddeeff )
    rom ( size 6 CRC " " Sha1 ba name "quote \\"in\\"" name "tail" )
)
Game ( name "no" rom ( name x ) )
machine ( description "D" disk ( sha1 ff ) rom ( name "cut" size 7'''

XML_CATALOG = '''<?xml version="1.0"?><datafile><header><name>n</name></header>
<game name="Test Game"><rom name="test.rom" size="4" crc="12345678" sha1="001122" /><disk name="d" sha1="aa"/></game>
<machine><description>Described</description><rom size="x"/></machine></datafile>'''


def test_catalog_files(spark, tmp_path):
    (tmp_path / "Atari - 2600.dat").write_text(TEXT_CATALOG)
    (tmp_path / "Nintendo - Game Boy.dat").write_text(XML_CATALOG)
    rows = catalogs.read_catalogs(spark, str(tmp_path), model.builtin_catalog_sources(spark))
    got = {(r.system_key, r.rom_name): (r.name, r.size, r.crc32, r.sha1) for r in rows.collect()}
    assert got == {
        ("ATARI2600", "LanternDrift.a26"): ("Lantern Drift (Test)", 5120, "00C0FFEE", "5EED5EED00112233445566778899AABBCCDDEEFF"),
        ("ATARI2600", "tail"): ("Lantern Drift (Test)", 6, None, "BA"),
        ("ATARI2600", "D"): ("D", 0, None, "FF"), ("ATARI2600", "cut"): ("D", 7, None, None),
        ("GB", "test.rom"): ("Test Game", 4, "12345678", "001122"), ("GB", "d"): ("Test Game", 0, None, "AA"),
        ("GB", "Described"): ("Described", 0, None, None)}
    order = [r.rom_name for r in rows.filter("system_key = 'GB'").orderBy("source_file", "position").collect()]
    assert order[:2] == ["test.rom", "d"]


def test_export_sink(spark, tmp_path):
    rows = spark.createDataFrame([("A:B", "A_B/x", bytearray(b"1")), ("C", "C/y", bytearray(b"2"))],
                                 "system_name string, target string, content binary")
    sinks.write_export(rows, str(tmp_path / "out"))
    back = {r.system: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {"A_B": b"1", "C": b"2"}


def test_systems_file(spark, tmp_path):
    path = tmp_path / "systems.json"
    path.write_text('[{"key": "A", "name": "Aa", "formats": [{"extension": "X", "formatName": "f", "priority": 3}]},\n'
                    ' {"key": "B", "name": "Bb", "enabled": false, "formats": [{"extension": ".Y", "isMultiFile": true}]}]')
    rows = catalogs.load_systems(spark, str(path)).orderBy("system_position").collect()
    assert [(r.system_key, r.extension, r.priority, r.is_multi_file, r.enabled) for r in rows] == [
        ("A", ".x", 3, False, True), ("B", ".y", 0, True, False)]


def test_run_markers(spark):
    at = datetime.fromisoformat
    rows = spark.createDataFrame(
        [("never", True, None, None), ("done", True, at("2020-01-01"), at("2020-01-02")),
         ("broken", True, at("2020-01-03"), at("2020-01-02")), ("first", True, at("2020-01-01"), None),
         ("off", False, at("2020-01-01"), None)],
        "location string, enabled boolean, last_started timestamp, last_completed timestamp")
    assert {r.location for r in reconcile.interrupted_runs(rows).collect()} == {"broken", "first"}
    roots = spark.createDataFrame([("/a", True, True)], "location string, recursive boolean, enabled boolean")
    wanted = spark.createDataFrame([("/a/", False), ("/b", True)], "location string, recursive boolean")
    grown = reconcile.add_locations(roots, wanted)
    assert {(r.location, r.recursive, r.enabled) for r in grown.collect()} == {("/a", True, True), ("/b", True, True)}
    off = reconcile.update_locations(grown, spark.createDataFrame([("/b", False, False)], "location string, enabled boolean, recursive boolean"))
    assert {(r.location, r.enabled) for r in off.collect()} == {("/a", True), ("/b", False)}
