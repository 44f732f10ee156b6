import os

from shelfmark.operators import reconcile
from shelfmark.plans.ordered import running_maximum
from shelfmark.sources import tree


def listed(spark, *roots, recursive=True):
    return tree.list_trees(spark.createDataFrame([(str(root), recursive) for root in roots], "location string, recursive boolean"))


def test_levels_links_and_problems(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    (one / "a/b/c").mkdir(parents=True)
    two.mkdir()
    (one / "top.nes").write_bytes(b"1")
    (one / "a/b/c/.hidden.NES").write_bytes(b"22")
    (two / "x").write_bytes(b"")
    os.symlink(one / "top.nes", one / "a" / "link.nes")      # a file by another name
    os.symlink(two, one / "a" / "other")                     # another folder
    os.symlink(one / "a", one / "a/b/back")                  # a folder above
    os.symlink(one / "a/loop", one / "a/loop")               # nothing that can be read
    os.symlink(one / "gone", one / "a/gone")                 # nothing at all
    os.mkfifo(one / "pipe")
    with open(os.path.join(os.fsencode(str(two)), b"bad\xff.nes"), "wb") as stream:
        stream.write(b"3")
    found = listed(spark, one, two, tmp_path / "nowhere")
    files = {(r.path.removeprefix(str(tmp_path)), r.size, r.extension, r.location.removeprefix(str(tmp_path))) for r in found.files.collect()}
    assert files == {("/one/top.nes", 1, ".nes", "/one"), ("/one/a/b/c/.hidden.NES", 2, ".nes", "/one"), ("/one/a/link.nes", 1, ".nes", "/one"),
                     ("/one/a/other/x", 0, "", "/one"), ("/two/x", 0, "", "/two")}
    problems = sorted((r.location.removeprefix(str(tmp_path)), r.path.removeprefix(str(tmp_path)), r.problem) for r in found.problems.collect())
    assert problems == [("/nowhere", "/nowhere", "ENOENT"), ("/one", "/one/a/loop", "ELOOP"), ("/one", "/one/a/other/bad?.nes", "name is not UTF-8"),
                        ("/two", "/two/bad?.nes", "name is not UTF-8")]
    runs = found.files.select("location").distinct().unionByName(spark.createDataFrame([(str(tmp_path / "nowhere"),)], "location string"))
    health = {r.location.removeprefix(str(tmp_path)): (r.error_count, r.complete) for r in reconcile.listing_health(runs, found.problems).collect()}
    assert health == {"/one": (2, False), "/two": (1, False), "/nowhere": (1, False)}
    assert {r.file_name for r in listed(spark, one, recursive=False).files.collect()} == {"top.nes"}


def test_a_very_wide_folder_is_inspected_in_ranges(spark, tmp_path):
    for n in range(100):
        (tmp_path / f"f{n}.bin").write_bytes(b"x" * n)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/deep.bin").write_bytes(b"")
    # Tasks run in other processes, so the logic of one level is driven here.
    import pandas as pd

    before, tree.NAMES_PER_RANGE = tree.NAMES_PER_RANGE, 7
    try:
        columns = [part.split()[0] for part in tree.FOUND.split(", ")]
        frontier, rounds, files = [("l", str(tmp_path), None, True)], 0, []
        while frontier:
            rows = pd.concat(tree._list_level([pd.DataFrame(frontier, columns=["location", "path", "names", "recursive"])]))
            assert list(rows.columns) == columns
            files += rows[rows["kind"] == tree.FILE]["path"].tolist()
            again = rows[rows["kind"] == tree.FOLDER]
            assert all(names is None or len(names) <= 7 for names in again["names"])
            frontier, rounds = list(zip(again["location"], again["path"], again["names"], again["recursive"])), rounds + 1
    finally:
        tree.NAMES_PER_RANGE = before
    assert len(files) == len(set(files)) == 101 and rounds >= 2


def test_no_locations(spark):
    found = listed(spark, "/x").files.limit(0)
    empty = tree.list_trees(spark.createDataFrame([], "location string, recursive boolean"))
    assert empty.files.count() == 0 and empty.problems.count() == 0 and empty.files.columns == found.columns


def test_running_maximum_over_ranges(spark):
    rows = spark.range(0, 3000).selectExpr("id", "CASE WHEN id % 97 = 5 THEN (id * 7919) % 1000 END AS value").repartition(7)
    got = [r.most for r in running_maximum(rows, ["id"], "value", "most").orderBy("id").collect()]
    want, most = [], None
    for n in range(3000):
        if n % 97 == 5:
            most = max(most or 0, n * 7919 % 1000)
        want.append(most)
    assert got == want


def test_packages_by_a_sweep(spark):
    """Nested packages, names that sort around the separator, a marker in the root."""
    paths = ["/r/PARAM.SFO", "/r/a/PARAM.SFO", "/r/a/x.bin", "/r/a/in/PS3_GAME/PARAM.SFO", "/r/a/in/deep/y.bin", "/r/a b/z.bin", "/r/a!/z.bin",
             "/r/a.b/PS3_GAME/PARAM.SFO", "/r/a.b/q.bin", "/r/b/c/PS3_GAME/PARAM.SFO", "/r/b/loose.bin", "/r/b/c/d/e/f.bin", "/r/ab/z.bin", "/r/a\u0001/z.bin"]
    listing = spark.createDataFrame([(p, p.rsplit("/", 1)[1], ".x", 1, None, n, "/r") for n, p in enumerate(paths)],
                                    "path string, file_name string, extension string, size long, created timestamp, modified int, location string").repartition(5)
    got = {r.path: (r.is_directory, r.size, r.modified, r.marker_path) for r in reconcile.collapse_packages(listing).collect()}
    loose = {p: (False, 1, n, None) for n, p in enumerate(paths) if p in
             {"/r/PARAM.SFO", "/r/a b/z.bin", "/r/a!/z.bin", "/r/b/loose.bin", "/r/ab/z.bin", "/r/a\u0001/z.bin"}}
    assert got == loose | {"/r/a": (True, 4, 4, "/r/a/PARAM.SFO"), "/r/a.b": (True, 2, 8, "/r/a.b/PS3_GAME/PARAM.SFO"),
                           "/r/b/c": (True, 2, 11, "/r/b/c/PS3_GAME/PARAM.SFO")}
