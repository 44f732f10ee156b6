"""Duplicates, preferred copies, fuzzy titles, merges and clean-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import hashing
from shelfmark.operators import curation, duplicate_counts, duplicates, preference
from shelfmark.plans.skew import lookup_join
from shelfmark.session import scratch_path
from shelfmark.sources.state import create_state
from shelfmark.workload.base import Tables, query, with_ctes
from shelfmark.workload.naming import NUMBER_SQL, RANK_SQL, SAMPLE, SCORE_SQL, strip_tags_sql

# --- exact duplicates: documents as files ------------------------------------------

_DOCS = {"docs": f"""SELECT CAST(doc_id AS STRING) AS file_key, '/docs/' || source || '/' || CAST(doc_id AS STRING) AS path,
    octet_length(encode(text)) AS size, upper(sha256(text)) AS sha256, lang, source,
    upper(sha256(encode(CAST(octet_length(encode(text)) AS STRING)) || encode(text)[1:{SAMPLE}] || CASE WHEN
      octet_length(encode(text)) > {SAMPLE} THEN encode(text)[octet_length(encode(text)) - {SAMPLE} + 1:
      octet_length(encode(text))] ELSE ''::BLOB END)) AS quick_hash FROM documents"""}


def document_files(t: Tables):
    """Documents as files with their quick hash; the content stays for a later full hash."""
    body, size = F.encode("text", "UTF-8"), F.octet_length("text").cast("long")
    return t.documents.select(
        F.col("doc_id").cast("string").alias("file_key"),
        F.concat_ws("/", F.lit("/docs"), "source", F.col("doc_id").cast("string")).alias("path"),
        size.alias("size"), hashing.quick_hash(body, size, SAMPLE).alias("quick_hash"), body.alias("content"),
        "lang", "source")


def _confirmed(t: Tables):
    files = document_files(t)
    collisions = duplicates.quick_hash_collisions(files.drop("content"))
    full = files.join(collisions.select("file_key"), "file_key", "left_semi").select(
        "file_key", hashing.sha256_hex(F.col("content")).alias("sha256"))
    return duplicates.confirm_duplicates(collisions, full)


@query("J7_quick_hash_collisions", with_ctes("", """SELECT file_key, block_size FROM (SELECT file_key,
    count(*) OVER (PARTITION BY quick_hash, size) AS block_size FROM docs) a WHERE block_size > 1""", _DOCS))
def j7(t: Tables):
    return duplicates.quick_hash_collisions(document_files(t).drop("content")).select("file_key", "block_size")


@query("J8_confirm_exact_duplicates", with_ctes("", """SELECT file_key, sha256, copies FROM (SELECT file_key, sha256,
    count(*) OVER (PARTITION BY sha256) AS copies FROM docs) a WHERE copies > 1""", _DOCS))
def j8(t: Tables):
    return _confirmed(t).select("file_key", "sha256", "copies")


@query("A6_duplicate_groups", with_ctes("", """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups,
    CAST(sum((n - 1) * size) AS BIGINT) AS reclaimable FROM (SELECT sha256, count(*) AS n, min(size) AS size
    FROM docs GROUP BY sha256 HAVING count(*) > 1) a""", _DOCS))
def a6(t: Tables):
    return duplicates.duplicate_groups(_confirmed(t))


@query("U4_mark_duplicates", with_ctes("", """SELECT file_key, CASE WHEN count(*) OVER (PARTITION BY sha256) > 1
    THEN 'Duplicate' WHEN lang = 'en' THEN 'Missing' ELSE 'Normal' END AS status FROM docs""", _DOCS))
def u4(t: Tables):
    files = document_files(t)
    hashes = files.select("file_key", F.lit("SHA256").alias("algorithm"), hashing.sha256_hex(F.col("content")).alias("hash"))
    table = files.select("file_key", F.when(F.col("lang") == "en", "Missing").otherwise("Normal").alias("status"))
    return duplicates.mark_duplicates(table, duplicates.files_with_shared_hash(hashes)).select("file_key", "status")


# --- preferred copies ------------------------------------------------------------------

def elect_ctes(source: str, prefix: str = "") -> dict[str, str]:
    """SQL that scores ``source`` and elects the best unit of each game."""
    return {
        f"{prefix}scores": f"""SELECT *, {SCORE_SQL} AS preference_score, coalesce('G' || file_group, 'F' || file_key) AS unit_key
            FROM (SELECT *, coalesce(catalog_name, file_name) AS label FROM {source}) a""",
        f"{prefix}units": f"""SELECT game_key, unit_key, bool_and(NOT is_excluded AND status <> 'Missing') AS eligible,
            max(preference_score) AS unit_score, min(upper(path)) AS first_path, count(*) AS unit_files
            FROM {prefix}scores WHERE game_key IS NOT NULL GROUP BY ALL""",
        f"{prefix}winners": f"""SELECT game_key, unit_key FROM (SELECT *, row_number() OVER (PARTITION BY game_key
            ORDER BY unit_score DESC, first_path) AS n FROM {prefix}units WHERE eligible) a WHERE n = 1""",
        f"{prefix}elected": f"""SELECT s.* EXCLUDE (is_preferred, unit_key, label), w.game_key IS NOT NULL AS is_preferred
            FROM {prefix}scores s LEFT JOIN {prefix}winners w ON w.game_key = s.game_key AND w.unit_key = s.unit_key""",
    }


_FLAGS = "file_key, game_key, preference_score, is_preferred, is_manual, is_excluded"
_FLAG_LIST = _FLAGS.split(", ")


@query("A11_preference_units", with_ctes("files", """SELECT game_key, unit_key, eligible, unit_score, first_path, unit_files
    FROM units""", elect_ctes("files")))
def a11(t: Tables):
    units = preference.preference_units(t.files)
    return units.withColumn("first_path", F.col("first.folded")).drop("first")


@query("R3_elect_preferred", with_ctes("files", f"SELECT {_FLAGS} FROM elected", elect_ctes("files")))
def r3(t: Tables):
    return preference.elect_preferred(t.files).select(_FLAG_LIST)


_TOUCHED_CTES = {
    "wanted_keys": "SELECT game_key FROM games WHERE is_wanted",
    "part_a": """SELECT * REPLACE (is_excluded OR NOT is_preferred AS is_excluded) FROM files
        WHERE game_key IN (SELECT game_key FROM wanted_keys) AND status <> 'Missing'""",
    "part_b": """SELECT * FROM files WHERE NOT (game_key IN (SELECT game_key FROM wanted_keys) AND status <> 'Missing')""",
    "part_c": """SELECT * REPLACE (false AS is_excluded, false AS is_manual) FROM files
        WHERE game_key IN (SELECT game_key FROM wanted_keys)""",
    "part_d": "SELECT * FROM files WHERE game_key NOT IN (SELECT game_key FROM wanted_keys)",
}
_SCORED_FILES = "SELECT *, 7 AS preference_score FROM files"


def _scored(t: Tables):
    return t.files.withColumn("preference_score", F.lit(7))


@query("U9_exclude_non_preferred", with_ctes("files games", f"""SELECT {_FLAGS} FROM elected UNION ALL
    SELECT {_FLAGS.replace('preference_score', '7')} FROM part_b""", {**_TOUCHED_CTES, **elect_ctes("part_a")}))
def u9(t: Tables):
    keys = t.games.filter("is_wanted").select("game_key")
    return preference.exclude_non_preferred(_scored(t), keys).select(_FLAG_LIST)


@query("U10_clear_overrides", with_ctes("files games", f"""SELECT {_FLAGS} FROM elected UNION ALL
    SELECT {_FLAGS.replace('preference_score', '7')} FROM part_d""", {**_TOUCHED_CTES, **elect_ctes("part_c")}))
def u10(t: Tables):
    keys = t.games.filter("is_wanted").select("game_key")
    return preference.clear_overrides(_scored(t), keys).select(_FLAG_LIST)


# Overrides: the revised copies; cartridge images by hand, the rest shut out.
@query("U8_set_copy_preference", with_ctes("files", f"""SELECT {_FLAGS} FROM elected UNION ALL
    SELECT {_FLAGS.replace('preference_score', '7')} FROM changed WHERE game_key NOT IN (SELECT game_key FROM touched)""", {
    "named": "SELECT file_key, game_key, extension = '.nes' AS manual, extension <> '.nes' AS excluded FROM files WHERE revision = 'Rev 1'",
    "touched": "SELECT game_key, max(file_key) FILTER (WHERE manual) AS chosen FROM named GROUP BY game_key",
    "changed": """SELECT f.* REPLACE (coalesce(n.excluded, f.is_excluded) AS is_excluded,
        CASE WHEN coalesce(n.excluded, false) OR (t.chosen IS NOT NULL AND t.chosen <> f.file_key) THEN false
             ELSE coalesce(n.manual, f.is_manual) END AS is_manual)
        FROM files f LEFT JOIN named n ON n.file_key = f.file_key LEFT JOIN touched t ON t.game_key = f.game_key""",
    "redo": "SELECT * FROM changed WHERE game_key IN (SELECT game_key FROM touched)", **elect_ctes("redo")}))
def u8(t: Tables):
    overrides = t.files.filter("revision = 'Rev 1'").select(
        "file_key", (F.col("extension") == ".nes").alias("manual"), (F.col("extension") != ".nes").alias("excluded"))
    return preference.set_copy_preference(_scored(t), overrides).select(_FLAG_LIST)


# --- fuzzy titles ------------------------------------------------------------------------

_TITLE = "lower(p_type) || p_name || p_type || ' ' || CAST(p_size % 3 AS STRING)"
_FUZZY_CTES = {
    "titles": f"""SELECT p_brand AS system_key, p_partkey AS id, regexp_replace(lower({_TITLE}), '[^a-z0-9]', '', 'g') AS title
        FROM part""",
    "buckets": "SELECT *, substr(title, 1, 1) || '-' || CAST(length(title) // 4 AS STRING) AS bucket FROM titles",
    "pairs": r"""SELECT a.system_key, a.id AS id_a, b.id AS id_b, a.title AS title_a, b.title AS title_b,
        1.0 - CAST(levenshtein(a.title, b.title) AS DOUBLE) / greatest(length(a.title), length(b.title)) AS similarity
        FROM buckets a JOIN buckets b ON a.system_key = b.system_key AND a.bucket = b.bucket AND a.id < b.id
        WHERE a.title <> b.title
          AND regexp_extract_all(a.title, '\d+') = regexp_extract_all(b.title, '\d+')""",
    "near": "SELECT * FROM pairs WHERE similarity >= 0.85",
}


def fuzzy_titles(t: Tables):
    from_part = F.expr(f"regexp_replace(lower({_TITLE}), '[^a-z0-9]', '')")
    return t.part.select(F.col("p_brand").alias("system_key"), F.col("p_partkey").alias("id"),
                         from_part.alias("normalised_title"))


@query("J13_fuzzy_title_pairs", with_ctes("", "SELECT system_key, id_a, id_b, similarity FROM near", _FUZZY_CTES))
def j13(t: Tables):
    return curation.fuzzy_title_pairs(fuzzy_titles(t)).select("system_key", "id_a", "id_b", "similarity")


@query("R5_fuzzy_topk", with_ctes("", """SELECT system_key, id_a, id_b, similarity FROM (SELECT *, row_number() OVER (
    PARTITION BY system_key ORDER BY similarity DESC, id_a, id_b) AS n FROM near) a WHERE n <= 300
    ORDER BY similarity DESC, system_key, id_a, id_b LIMIT 300""", _FUZZY_CTES))
def r5(t: Tables):
    return curation.fuzzy_top(curation.fuzzy_title_pairs(fuzzy_titles(t))).select(
        "system_key", "id_a", "id_b", "similarity")


# --- exact titles and merges ---------------------------------------------------------------

_GROUP_CTES = {
    "present": "SELECT part_key AS game_key, count(*) FILTER (WHERE status <> 'Missing') AS n FROM files GROUP BY part_key",
    "counted": """SELECT g.*, s.system_name, coalesce(p.n, 0) AS file_count FROM part_games g
        JOIN brands s ON s.system_key = g.system_key LEFT JOIN present p ON p.game_key = g.game_key""",
    "grouped": """SELECT *, count(*) OVER w AS games, CAST(sum(file_count) OVER w AS BIGINT) AS total_files,
        first_value(game_key) OVER (PARTITION BY system_key, title ORDER BY file_count DESC, game_key) AS keep_key
        FROM counted WINDOW w AS (PARTITION BY system_name, title)""",
}


@query("A7_exact_title_groups", with_ctes("files part_games brands", """SELECT system_name, title, total_files, games, game_key
    FROM grouped WHERE games > 1""", _GROUP_CTES))
def a7(t: Tables):
    return curation.exact_title_members(t.part_games, t.part_files, t.brands)


@query("R4_merge_survivor", with_ctes("files part_games brands", """SELECT DISTINCT system_key, title, keep_key, games
    FROM grouped WHERE games > 1""", _GROUP_CTES))
def r4(t: Tables):
    return curation.merge_survivors(t.part_games, t.part_files)


_FILE_FLAGS = "file_key, game_key, is_preferred, preference_score"


def _merged_ctes(remap: str) -> dict[str, str]:
    return {"remap": remap, "moved": """SELECT f.* EXCLUDE (game_key, part_key) REPLACE (CASE WHEN r.keep_key IS NOT NULL
            THEN f.file_group || '@' || CAST(f.part_key AS STRING) ELSE f.file_group END AS file_group),
            coalesce(r.keep_key, f.part_key) AS game_key FROM files f LEFT JOIN remap r ON r.game_key = f.part_key""",
            "redo": "SELECT * FROM moved WHERE game_key IN (SELECT keep_key FROM remap)", **elect_ctes("redo")}


_MERGED_SQL = f"""SELECT {_FILE_FLAGS} FROM elected UNION ALL SELECT file_key, game_key, is_preferred, 7
    FROM moved WHERE game_key NOT IN (SELECT keep_key FROM remap)"""


def _scored_parts(t: Tables):
    return t.part_files.withColumn("preference_score", F.lit(7))


@query("U12_merge_exact_titles", with_ctes("files part_games brands", _MERGED_SQL, {
    **_GROUP_CTES, **_merged_ctes("SELECT game_key, keep_key FROM grouped WHERE games > 1 AND game_key <> keep_key")}))
def u12(t: Tables):
    decisions = curation.exact_title_decisions(t.part_games, t.part_files)
    _, files = curation.apply_merges(t.part_games, _scored_parts(t), decisions)
    return files.select(_FILE_FLAGS.split(", "))


# Merge pairs: parts of one brand and name that share their type or their size with the first such part.
_PAIRS_SQL = """SELECT min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_type) AS keep, p_partkey AS drop_key FROM part
    UNION ALL SELECT min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_size), p_partkey FROM part"""
_COMPONENT_CTES = {
    "pairs": _PAIRS_SQL,
    "edges": "SELECT keep AS a, drop_key AS b FROM pairs WHERE keep <> drop_key UNION SELECT drop_key, keep FROM pairs WHERE keep <> drop_key",
    "reach": """SELECT DISTINCT a AS node, a AS other FROM edges WHERE a NOT IN (SELECT a FROM edges WHERE b < a)
        UNION SELECT e.b, r.other FROM reach r JOIN edges e ON e.a = r.node""",
    "roots": "SELECT node AS game_key, min(other) AS root FROM reach GROUP BY node",
    "present": "SELECT part_key AS game_key, count(*) FILTER (WHERE status <> 'Missing') AS n FROM files GROUP BY part_key",
    "survivors": """SELECT r.game_key, first_value(r.game_key) OVER (PARTITION BY r.root
        ORDER BY r.game_key IN (SELECT drop_key FROM pairs WHERE keep <> drop_key), coalesce(p.n, 0) DESC, r.game_key) AS keep_key
        FROM roots r LEFT JOIN present p ON p.game_key = r.game_key""",
}


def merge_pairs(t: Tables):
    keys = t.part.select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    def star(column: str):
        first = keys.groupBy("p_brand", "p_name", column).agg(F.min("p_partkey").alias("keep"))
        return keys.join(first, ["p_brand", "p_name", column]).select("keep", F.col("p_partkey").alias("drop"))
    return star("p_type").unionByName(star("p_size"))


@query("U11_merge_games", with_ctes("files part_games", _MERGED_SQL, {
    **_COMPONENT_CTES, **_merged_ctes("SELECT game_key, keep_key FROM survivors WHERE game_key <> keep_key")}).replace(
    "WITH ", "WITH RECURSIVE ", 1))
def u11(t: Tables):
    decisions = curation.merge_decisions(t.part_games, t.part_files, merge_pairs(t))
    _, files = curation.apply_merges(t.part_games, _scored_parts(t), decisions)
    return files.select(_FILE_FLAGS.split(", "))


@query("U11_merge_decisions", with_ctes("files part_games", """SELECT game_key, keep_key FROM survivors
    WHERE game_key <> keep_key""", _COMPONENT_CTES).replace("WITH ", "WITH RECURSIVE ", 1))
def u11_decisions(t: Tables):
    return curation.merge_decisions(t.part_games, t.part_files, merge_pairs(t))


# --- title clean-up ----------------------------------------------------------------------------

_CLEANUP_CTES = {
    "habits": f"""SELECT s.system_name, count(*) FILTER (WHERE {NUMBER_SQL} IS NOT NULL) AS prefixed, count(*) AS titles,
        count(*) FILTER (WHERE {NUMBER_SQL} IS NOT NULL) >= 5 AS widespread
        FROM ranked_games g JOIN brands s ON s.system_key = g.system_key GROUP BY s.system_name""",
    "verified": """SELECT game_key, catalog_name AS verified_name FROM (SELECT part_key AS game_key, catalog_name,
        row_number() OVER (PARTITION BY part_key ORDER BY is_preferred DESC, file_key) AS n FROM files
        WHERE catalog_status = 'Verified' AND catalog_name IS NOT NULL) a WHERE n = 1""",
    # Every second-hand name counts: only parts of small size keep their verified name here.
    "kept": """SELECT v.* FROM verified v JOIN part p ON p.p_partkey = v.game_key WHERE p.p_size < 15 OR p.p_size > 40""",
    "bases": f"""SELECT g.game_key, s.system_name, g.title, k.verified_name,
        CASE WHEN trim(coalesce(k.verified_name, '')) <> '' THEN k.verified_name
             WHEN h.widespread THEN {NUMBER_SQL} ELSE {RANK_SQL} END AS base
        FROM ranked_games g JOIN brands s ON s.system_key = g.system_key JOIN habits h ON h.system_name = s.system_name
        LEFT JOIN kept k ON k.game_key = g.game_key""",
    "suggestions": f"""SELECT *, trim({strip_tags_sql('base')}) AS suggested_title FROM bases WHERE base IS NOT NULL""",
    "cleanup": """SELECT game_key, system_name, title AS current_title, suggested_title,
        CASE WHEN trim(coalesce(verified_name, '')) <> '' THEN 'Matches verified catalog name'
             ELSE 'Removes numeric catalog-rank prefix' END AS reason
        FROM suggestions WHERE suggested_title <> '' AND suggested_title <> title""",
}


def _cleanup_files(t: Tables):
    sizes = t.part.select(F.col("p_partkey").alias("game_key"), "p_size")
    status = F.when(F.col("p_size").between(15, 40), "NoMatch").otherwise(F.col("catalog_status"))
    return t.part_files.join(sizes, "game_key").withColumn("catalog_status", status).drop("p_size")


def cleanup_candidates(t: Tables):
    return curation.title_cleanup_candidates(t.ranked_games, _cleanup_files(t), t.brands)


@query("A8_rank_prefix_convention", with_ctes("ranked_games brands", "SELECT * FROM habits",
                                              {"habits": _CLEANUP_CTES["habits"]}))
def a8(t: Tables):
    return curation.rank_prefix_convention(t.ranked_games, t.brands)


@query("R6_best_verified_name", with_ctes("files", "SELECT * FROM verified", {"verified": _CLEANUP_CTES["verified"]}))
def r6(t: Tables):
    return curation.best_verified_name(t.part_files)


@query("U13_title_cleanup_candidates", with_ctes("files ranked_games brands", "SELECT * FROM cleanup", _CLEANUP_CTES))
def u13(t: Tables):
    return cleanup_candidates(t)


@query("U14_apply_title_cleanup", with_ctes("files ranked_games brands", """SELECT g.game_key, g.normalised_title,
    coalesce(c.suggested_title, g.title) AS title,
    CASE WHEN upper(substr(c.suggested_title, 1, 4)) = 'THE ' THEN substr(c.suggested_title, 5) || ', The'
         ELSE coalesce(c.suggested_title, g.sort_title) END AS sort_title
    FROM ranked_games g LEFT JOIN cleanup c ON c.game_key = g.game_key""", _CLEANUP_CTES))
def u14(t: Tables):
    titles = cleanup_candidates(t).select("game_key", F.col("suggested_title").alias("new_title"))
    return curation.apply_title_cleanup(t.ranked_games, titles).select(
        "game_key", "normalised_title", "title", "sort_title")


# --- manual assignment -------------------------------------------------------------------------

# Order files by text key; disc images that need review go to one of two disc systems.
_ASSIGN_CTES = {
    "owned_games": "SELECT * REPLACE ('g' || CAST(game_key AS STRING) AS game_key) FROM games",
    "owned_files": "SELECT * REPLACE ('g' || CAST(game_key AS STRING) AS game_key) FROM files",
    "moves": """SELECT f.file_key, f.path, f.game_key AS old_key, CASE WHEN f.is_manual THEN 'PS2' ELSE 'SATURN' END AS target,
        CASE WHEN f.is_manual THEN 'PS2' ELSE 'SATURN' END || ':' || g.normalised_title AS new_key, g.title,
        CASE WHEN f.is_manual THEN 'PS2 ISO' ELSE 'ISO' END AS new_format,
        CASE WHEN f.is_manual THEN 'PlayStation 2' ELSE 'Sega Saturn' END AS target_name
        FROM owned_files f JOIN owned_games g ON g.game_key = f.game_key WHERE f.extension = '.iso' AND f.confidence < 0.75""",
}


def assigned(t: Tables):
    text_key = F.concat(F.lit("g"), F.col("game_key").cast("string"))
    games = t.games.withColumn("game_key", text_key)
    files = t.files.withColumns({"game_key": text_key, "system_key": F.lit("OLD"), "reason": F.lit("Extension and path hints"),
                                 "is_detection_manual": F.lit(False)})
    chosen = files.filter("extension = '.iso' and confidence < 0.75").select(
        "file_key", F.when(F.col("is_manual"), "PS2").otherwise("SATURN").alias("system_key"))
    return curation.assign_system(games, files, chosen, t.formats)


@query("U15_assign_system", with_ctes("files games", """SELECT f.file_key, coalesce(m.new_key, f.game_key) AS game_key,
    coalesce(m.new_format, f.format_name) AS format_name, CASE WHEN m.file_key IS NOT NULL THEN 1.0 ELSE f.confidence END::DOUBLE AS confidence,
    CASE WHEN m.file_key IS NOT NULL THEN 'Manually assigned to ' || m.target_name ELSE 'Extension and path hints' END AS reason,
    m.file_key IS NOT NULL AS is_detection_manual,
    CASE WHEN m.file_key IS NOT NULL AND (SELECT count(*) FROM moves x WHERE x.new_key = m.new_key) > 1 THEN false
         ELSE f.is_preferred END AS is_preferred
    FROM owned_files f LEFT JOIN moves m ON m.file_key = f.file_key""", _ASSIGN_CTES))
def u15(t: Tables):
    _, files = assigned(t)
    return files.select("file_key", "game_key", "format_name", "confidence", "reason", "is_detection_manual", "is_preferred")


@query("U15_assigned_games", with_ctes("files games", """SELECT game_key, system_key, title FROM owned_games UNION ALL
    SELECT new_key, target, title FROM (SELECT *, row_number() OVER (PARTITION BY new_key ORDER BY upper(path)) AS n
    FROM moves) a WHERE n = 1""", _ASSIGN_CTES))
def u15_games(t: Tables):
    games, _ = assigned(t)
    return games.select("game_key", "system_key", "title")


# --- state that follows from run to run ------------------------------------------------------------

# Files with a content of their part and size; those shipped late are new in the second run, which has lost the returned ones.
_CONTENT = "md5(concat(CAST(part_key AS STRING), '-', CAST(size % 3 AS STRING)))"


@query("U4_duplicate_counts", with_ctes("files", """SELECT file_key, CASE WHEN count(*) OVER (PARTITION BY sha256) > 1 THEN 'Duplicate' ELSE 'Normal' END AS status
    FROM (SELECT file_key, md5(CAST(part_key AS STRING) || '-' || CAST(size % 3 AS STRING)) AS sha256, modified, status FROM files) a
    WHERE modified >= TIMESTAMP '1998-06-01 00:00:00' OR status <> 'Duplicate'"""))
def u4_counts(t: Tables):
    files = t.files.select("file_key", F.expr(_CONTENT).alias("sha256"), (F.col("modified") >= F.lit("1998-06-01").cast("timestamp_ntz")).alias("late"),
                           (F.col("status") == "Duplicate").alias("returned"))
    first, gained, lost = files.filter("NOT late"), files.filter("late"), files.filter("NOT late AND returned")
    path = scratch_path(t.spark, "counts")
    counts = duplicate_counts.count_copies(first).checkpoint()
    state = duplicate_counts.start_counts(first, path, 16, counts)
    before = lookup_join(first.select("file_key", "sha256"), counts, ["sha256"], "copies", "inner").select(
        "file_key", F.when(F.col("copies") > 1, "Duplicate").otherwise("Normal").alias("status"))
    present = files.filter("late OR NOT returned")
    changed = duplicate_counts.follow_run(state, 0, gained, lost, present, flag="late")
    kept = present.select("file_key").join(before, "file_key", "left").join(changed.withColumnRenamed("status", "new"), "file_key", "left")
    return kept.select("file_key", F.coalesce("new", "status").alias("status"))


@query("U2_state_in_buckets", with_ctes("files", """SELECT file_key, CASE WHEN game_key % 50 = 0 THEN size + 1 ELSE size END AS size,
    CASE WHEN game_key % 50 = 0 THEN 'Touched' ELSE status END AS status FROM files WHERE game_key % 70 <> 7"""))
def u2_buckets(t: Tables):
    """A table of files, a run that changes some, and one that removes some."""
    state = create_state(t.files.select("file_key", "size", "status"), scratch_path(t.spark, "files"), "file_key", 16)
    changed = t.files.filter("game_key % 50 = 0").select("file_key", (F.col("size") + 1).alias("size"), F.lit("Touched").alias("status"))
    state.merge(0, changed)
    state.merge(1, removed=t.files.filter("game_key % 70 = 7").select("file_key"))
    return state.read(2)
