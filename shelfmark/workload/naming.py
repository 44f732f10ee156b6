"""Names, titles and content hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import hashing, text
from shelfmark.operators import resolve
from shelfmark.functions.scoring import preference_score
from shelfmark.workload.base import Tables, query, with_ctes
from shelfmark.fixed_values import LANGUAGES, REGIONS

_REGION_LIST = ", ".join(f"'{word.upper()}'" for word in REGIONS)
_LANGUAGE_CASE = " ".join(f"WHEN '{key.upper()}' THEN '{value}'" for key, value in LANGUAGES.items())

# The naming convention in SQL: one row per word inside the tags of a name.
PARSE_CTES = {
    "stems": r"""SELECT *, trim(replace(regexp_replace(file_name, '\.[^.]*$', ''), '_', ' ')) AS stem FROM names""",
    "tag_words": r"""SELECT part_key, tag_no, word_no, trim(word) AS word FROM (
        SELECT part_key, tag_no, unnest(string_split(tag[2:-2], ',')) AS word,
               generate_subscripts(string_split(tag[2:-2], ','), 1) AS word_no
        FROM (SELECT part_key, unnest(regexp_extract_all(stem, '\(([^)]*)\)|\[([^\]]*)\]')) AS tag,
                     generate_subscripts(regexp_extract_all(stem, '\(([^)]*)\)|\[([^\]]*)\]'), 1) AS tag_no FROM stems) a) b
        WHERE trim(word) <> ''""",
    "kinds": rf"""SELECT *, CASE WHEN upper(word) IN ({_REGION_LIST}) THEN 'region'
        WHEN (CASE upper(word) {_LANGUAGE_CASE} END) IS NOT NULL THEN 'language'
        WHEN regexp_matches(word, '(?i)^Rev(?:ision)?\s*[A-Z0-9.]+$') THEN 'revision'
        WHEN regexp_matches(word, '(?i)^(?:v|Version\s*)[0-9][\w.\-]*$') THEN 'version' ELSE 'tag' END AS kind,
        CASE upper(word) {_LANGUAGE_CASE} END AS language FROM tag_words""",
    "firsts": """SELECT part_key, kind, coalesce(language, word) AS word, min(tag_no * 1000 + word_no) AS place
        FROM kinds WHERE kind IN ('region', 'language') GROUP BY ALL""",
    "lists": """SELECT part_key, string_agg(word, ', ' ORDER BY place) FILTER (WHERE kind = 'region') AS region,
        string_agg(word, ', ' ORDER BY place) FILTER (WHERE kind = 'language') AS language FROM firsts GROUP BY part_key""",
    "others": """SELECT part_key, arg_max(word, tag_no * 1000 + word_no) FILTER (WHERE kind = 'revision') AS revision,
        arg_max(word, tag_no * 1000 + word_no) FILTER (WHERE kind = 'version') AS version,
        string_agg(word, '|' ORDER BY tag_no, word_no) FILTER (WHERE kind = 'tag') AS tags FROM kinds GROUP BY part_key""",
    "titles": r"""SELECT part_key, stem, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem,
        '\(([^)]*)\)|\[([^\]]*)\]', ' ', 'g'), '(?i)(?:Disc|Disk|CD)\s*0*([0-9]+)', ' ', 'g'),
        '(?i)Track\s*0*([0-9]+)', ' ', 'g'), '\s{2,}|\s+-\s*$', ' ', 'g'), ' -.') AS bare FROM stems""",
    "parsed": r"""SELECT n.part_key, n.system_key, n.path, CASE WHEN trim(t.bare) = '' THEN t.stem ELSE t.bare END AS title,
        coalesce(l.region, '') AS region, coalesce(l.language, '') AS language, o.revision, o.version,
        TRY_CAST(nullif(regexp_extract(t.stem, '(?i)(?:Disc|Disk|CD)\s*0*([0-9]+)', 1), '') AS INTEGER) AS disc_number,
        TRY_CAST(nullif(regexp_extract(t.stem, '(?i)Track\s*0*([0-9]+)', 1), '') AS INTEGER) AS track_number,
        coalesce(o.tags, '') AS tags FROM names n JOIN titles t USING (part_key)
        LEFT JOIN lists l USING (part_key) LEFT JOIN others o USING (part_key)""",
}


def parsed_names(t: Tables):
    return resolve.parse_titles(t.names)


@query("C1_parse_name", with_ctes("names", "SELECT part_key, title, region, language, revision, version, tags FROM parsed",
                                  PARSE_CTES))
def c1(t: Tables):
    rows = parsed_names(t).withColumn("tags", F.array_join("tags", "|"))
    return rows.select("part_key", "title", "region", "language", "revision", "version", "tags")


@query("C2_disc_and_track", with_ctes("names", "SELECT part_key, disc_number, track_number FROM parsed", PARSE_CTES))
def c2(t: Tables):
    return parsed_names(t).select("part_key", "disc_number", "track_number")


# Whole texts as titles: accents of four languages, digits, signs.
@query("C3_normalise_title", r"""SELECT doc_id, length(t) AS letters, sha256(t) AS digest FROM (
    SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{Nd}]', '', 'g') AS t FROM documents) a""")
def c3(t: Tables):
    rows = t.documents.select("doc_id", text.normalise_title(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("letters"), F.sha2("t", 256).alias("digest"))


@query("C4_grouping_key", with_ctes("part_games", """SELECT system_key || ':' || normalised_title AS game_key,
    count(*) AS parts FROM part_games GROUP BY ALL"""))
def c4(t: Tables):
    normal = text.normalise_title(F.col("p_name"))
    return (t.part.groupBy(text.game_key(F.col("p_brand"), normal).alias("game_key"))
            .agg(F.count("*").alias("parts")))


@query("C5_sort_title", with_ctes("games", "SELECT game_key, title, sort_title FROM games"))
def c5(t: Tables):
    return t.games.select("game_key", "title", text.sort_title(F.col("title")).alias("sort_title"))


_RANK = r"""nullif(trim(regexp_replace(title, '^0\d{2,5}[\s\-]+', '')), '')"""
_NUMBER = r"""nullif(trim(regexp_replace(title, '^\d{2,5}[\s\-]+', '')), '')"""
RANK_SQL = rf"CASE WHEN regexp_matches(title, '^0\d{{2,5}}[\s\-]+') THEN {_RANK} END"
NUMBER_SQL = rf"CASE WHEN regexp_matches(title, '^\d{{2,5}}[\s\-]+') THEN {_NUMBER} END"


@query("C6_strip_rank_prefix", with_ctes("ranked_games", f"SELECT game_key, {RANK_SQL} AS stripped FROM ranked_games"))
def c6(t: Tables):
    return t.ranked_games.select("game_key", text.strip_rank_prefix(F.col("title")).alias("stripped"))


@query("C7_strip_any_number_prefix",
       with_ctes("ranked_games", f"SELECT game_key, {NUMBER_SQL} AS stripped FROM ranked_games"))
def c7(t: Tables):
    return t.ranked_games.select("game_key", text.strip_any_number_prefix(F.col("title")).alias("stripped"))


def strip_tags_sql(column: str) -> str:
    return rf"""CASE WHEN rtrim(regexp_replace({column}, '(?:\s*[\(\[][^()\[\]]*[\)\]]\s*)+$', '')) <> ''
        THEN rtrim(regexp_replace({column}, '(?:\s*[\(\[][^()\[\]]*[\)\]]\s*)+$', ''))
        ELSE rtrim(regexp_extract({column}, '^(\s*[\(\[][^()\[\]]*[\)\]])', 1)) END"""


@query("C8_strip_trailing_tags",
       with_ctes("ranked_games", f"SELECT game_key, {strip_tags_sql('title')} AS stripped FROM ranked_games"))
def c8(t: Tables):
    return t.ranked_games.select("game_key", text.strip_trailing_tags(F.col("title")).alias("stripped"))


@query("C9_title_similarity", """SELECT p_partkey, CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1.0 ELSE
    1.0 - CAST(levenshtein(p_name, lower(p_type)) AS DOUBLE) / greatest(length(p_name), length(p_type)) END AS similarity
    FROM part""")
def c9(t: Tables):
    return t.part.select("p_partkey", text.title_similarity(F.col("p_name"), F.lower("p_type")).alias("similarity"))


@query("C10_numbers_in_title", r"""SELECT page_id, array_to_string(regexp_extract_all(url, '\d+'), ',') AS in_url,
    array_to_string(regexp_extract_all(html, '\d+'), ',') AS in_html,
    regexp_extract_all(url, '\d+') = regexp_extract_all(html, '\d+') AS equal FROM pages""")
def c10(t: Tables):
    url, html = text.title_numbers(F.col("url")), text.title_numbers(F.col("html"))
    return t.pages.select("page_id", F.array_join(url, ",").alias("in_url"), F.array_join(html, ",").alias("in_html"),
                          (url == html).alias("equal"))


@query("C11_fuzzy_bucket", """SELECT bucket, count(*) AS documents FROM (SELECT CASE WHEN text = '' THEN '' ELSE
    substr(text, 1, 1) || '-' || CAST(length(text) // 4 AS STRING) END AS bucket FROM documents) a GROUP BY bucket""")
def c11(t: Tables):
    return (t.documents.groupBy(text.fuzzy_bucket(F.col("text")).alias("bucket"))
            .agg(F.count("*").alias("documents")))


SCORE_SQL = """CASE WHEN is_excluded OR status = 'Missing' THEN -10000 ELSE
    CASE WHEN is_manual THEN 5000 WHEN catalog_status = 'Verified' THEN 1000 ELSE 0 END
    + CASE WHEN upper(label) LIKE '%(USA)%' OR upper(label) LIKE '%(WORLD)%' THEN 120
           WHEN upper(label) LIKE '%(EUROPE)%' THEN 80 WHEN upper(label) LIKE '%(JAPAN)%' THEN 40 ELSE 0 END
    + CASE WHEN trim(coalesce(revision, '')) <> '' THEN 10 ELSE 0 END
    + CASE WHEN upper(label) LIKE '%(BETA%' OR upper(label) LIKE '%(PROTO%' OR upper(label) LIKE '%(DEMO%'
             OR upper(label) LIKE '%(SAMPLE%' OR upper(label) LIKE '%[B%' OR upper(label) LIKE '%(PIRATE%'
             OR upper(label) LIKE '%(HACK%' THEN -300 ELSE 0 END
    + CASE WHEN status = 'Corrupt' THEN -1000 ELSE 0 END + CASE WHEN lower(extension) = '.zip' THEN 5 ELSE 0 END END"""


@query("C12_preference_score", with_ctes("files", f"""SELECT file_key, {SCORE_SQL} AS preference_score
    FROM (SELECT *, coalesce(catalog_name, file_name) AS label FROM files) a"""))
def c12(t: Tables):
    score = preference_score(**{name: F.col(name) for name in (
        "status", "catalog_status", "catalog_name", "file_name", "revision", "extension")},
        excluded=F.col("is_excluded"), manual=F.col("is_manual"))
    return t.files.select("file_key", score.alias("preference_score"))


# --- content hashes ----------------------------------------------------------

SAMPLE = 1024  # below the longest texts, so that both branches are taken


@query("C13_quick_hash", f"""SELECT doc_id, upper(sha256(encode(CAST(n AS STRING)) || body[1:{SAMPLE}]
    || CASE WHEN n > {SAMPLE} THEN body[n - {SAMPLE} + 1:n] ELSE ''::BLOB END)) AS quick_hash
    FROM (SELECT doc_id, encode(text) AS body, octet_length(encode(text)) AS n FROM documents) a""")
def c13(t: Tables):
    body = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", hashing.quick_hash(
        body, F.octet_length("text").cast("long"), SAMPLE).alias("quick_hash"))


@query("C14_sha256", "SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents")
def c14(t: Tables):
    return t.documents.select("doc_id", hashing.sha256_hex(F.encode("text", "UTF-8")).alias("sha256"))


def _crc_sql() -> str:
    """CRC-32 folded over the bytes of a blob; its table follows from the polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(str(value))
    return f"""upper(lpad(printf('%x', xor(list_reduce(
        list_transform(regexp_extract_all(hex(body), '..'), lambda h: CAST('0x' || h AS BIGINT)),
        lambda crc, byte: xor(([{', '.join(table)}]::BIGINT[])[CAST(xor(crc, byte) & 255 AS INTEGER) + 1], crc >> 8),
        4294967295::BIGINT), 4294967295::BIGINT)), 8, '0'))"""


CRC_SQL = _crc_sql()


@query("C15_sha1_crc32", f"""SELECT doc_id, upper(sha1(body)) AS sha1, {CRC_SQL} AS crc32,
    upper(sha1(body[17:])) AS payload_sha1 FROM (SELECT doc_id, encode(text) AS body FROM documents) a""")
def c15(t: Tables):
    body = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", hashing.sha1_hex(body).alias("sha1"), hashing.crc32_hex(body).alias("crc32"),
                              hashing.sha1_hex(hashing.payload(body, F.lit(16))).alias("payload_sha1"))


@query("C16_header_skip", with_ctes("files", """SELECT file_key, CASE
    WHEN extension = '.nes' AND bytes > 16 AND (bytes - 16) % 8192 = 0 THEN 16
    WHEN extension = '.sfc' AND bytes > 512 AND bytes % 1024 = 512 THEN 512
    WHEN extension = '.md' AND bytes > 16 AND (bytes - 16) % 65500 = 0 THEN 16 ELSE 0 END AS header_skip
    FROM (SELECT *, CASE extension WHEN '.nes' THEN size // 1000 * 4096 + 16 WHEN '.sfc' THEN size // 1000 * 512
                    WHEN '.md' THEN size // 100000 * 32750 + 16 ELSE size END AS bytes FROM files) a"""))
def c16(t: Tables):
    # Sizes rounded to half a bank, so that headed, plain and odd files all occur.
    rows = t.files.selectExpr("file_key", "extension", """CASE extension WHEN '.nes' THEN size div 1000 * 4096 + 16
        WHEN '.sfc' THEN size div 1000 * 512 WHEN '.md' THEN size div 100000 * 32750 + 16 ELSE size END AS bytes""")
    system = F.when(F.col("extension") == ".nes", "NES").when(F.col("extension") == ".sfc", "SNES") \
              .when(F.col("extension") == ".md", "FDS").otherwise("GB")
    extension = F.when(F.col("extension") == ".md", ".fds").otherwise(F.col("extension"))
    return rows.select("file_key", hashing.header_skip(system, extension, F.col("bytes")).alias("header_skip"))


@query("C17_sanitise_folder", r"""SELECT page_id, regexp_replace(url, '["<>|:*?\\/\x00-\x1f]', '_', 'g') AS folder,
    sha256(regexp_replace(html, '["<>|:*?\\/\x00-\x1f]', '_', 'g')) AS body FROM pages""")
def c17(t: Tables):
    return t.pages.select("page_id", text.sanitise_folder(F.col("url")).alias("folder"),
                          F.sha2(text.sanitise_folder(F.col("html")), 256).alias("body"))
