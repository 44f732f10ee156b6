"""Text catalogs of any size, read in chunks that find out by themselves where in the nesting they stand.

A file is read as pieces that end at closing brackets, and successive pieces form chunks, so a chunk begins either between two
tokens or inside a quoted text, at some depth of open blocks:

1. Each chunk reports, for every state it could begin in, the state it ends in and the games it opens.
2. Per file, these small reports are applied one after the other, which gives each chunk its start state.
3. Each chunk looks for the first place where no block inside a game is open; what stands before belongs to the chunk before.
   From there it reads its records by itself. Names of games, which may stand in another chunk than their records, are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import base_name
from shelfmark.plans.skew import lookup_join
from shelfmark.session import scratch_path

#: Characters of a chunk, about; records and fields of games that a task hands on at a time, at least.
CHUNK, ROWS = 1 << 20, 10_000
#: A quoted text (with \" for a quote) and its end, a bracket, or a bare word; the rest of a quoted text.
TOKEN = re.compile(r'"((?:\\"|[^"])*)("|\Z)|([()])|([^\s()"][^\s()]*)')
REST_OF_QUOTE = re.compile(r'((?:\\"|[^"])*)("|\Z)')
GAMES, RECORDS = ("game", "machine"), ("rom", "disk")
FIELDS = ("name", "size", "crc", "md5", "sha1", "sha256")

_KEY = "source_file string, block long, number int"


def read_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(source_file, block, number, text): the files below ``path`` in chunks, each but a file's last ending with a closing bracket."""
    pieces = (spark.read.option("lineSep", ")").text(path)
              .select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), "value"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number, held, length = None, 0, [], 0
        for batch in batches:
            done = []
            for source, block, piece in zip(batch["source_file"], batch["block"], batch["value"]):
                if held and ((source, block) != at or length >= size):
                    done.append((*at, number, ")".join(held) + ")"))
                    held, length = [], 0
                    number += 1
                if (source, block) != at:
                    at, number = (source, block), 0
                held.append(piece)
                length += len(piece) + 1
            yield pd.DataFrame(done, columns=["source_file", "block", "number", "text"])
        if held:
            yield pd.DataFrame([(*at, number, ")".join(held) + ")")], columns=["source_file", "block", "number", "text"])

    return pieces.mapInPandas(cut, f"{_KEY}, text string")


def tokens(text: str, quoted: bool) -> Iterator[tuple[str, str, int, bool]]:
    """(kind, value, end, open) from a chunk that begins outside or inside a quoted text; ``open``: the text ends inside it."""
    at = 0
    if quoted:
        rest = REST_OF_QUOTE.match(text)
        at = rest.end()
        yield "rest", rest.group(1), at, not rest.group(2)
    for found in TOKEN.finditer(text, at):
        value, end, bracket, word = found.groups()
        if bracket:
            yield bracket, bracket, found.end(), False
        elif word is not None:
            yield "word", word, found.end(), False
        else:
            yield "text", value, found.end(), not end


def walk(found: Iterable[tuple[str, str, int, bool]], depth: int) -> tuple[bool, int, int, int]:
    """(ends inside a quoted text, depth at the end, games opened, lowest depth) of a chunk's ``tokens`` that begin at a given depth.

    A block opens behind a word, outside of blocks only behind the word of a game.
    """
    word, opened, lowest, inside = None, 0, depth, False
    for kind, value, _, inside in found:
        before, word = word, None
        if kind == "(":
            if before is not None and (depth or before in GAMES):
                opened += not depth
                depth += 1
        elif kind == ")":
            depth = max(0, depth - 1)
            lowest = min(lowest, depth)
        elif before is None or not depth or kind == "rest":
            # A word waits for its value; behind a value, and outside of blocks, none waits.
            word = value if kind == "word" else None
    return inside, depth, opened, lowest


def reports(text: str) -> list[tuple[bool, int, bool, int, int]]:
    """(quoted, depth, quoted at the end, depth at the end, games opened) for start depths from 0 up to the first from which 0 is not reached.

    All deeper starts behave like the last one, shifted. The tokens do not depend on the depth, so each text is cut twice only.
    """
    out = []
    for quoted in (False, True):
        found, depth = list(tokens(text, quoted)), 0
        while True:
            inside, end, opened, lowest = walk(found, depth)
            out.append((quoted, depth, inside, end, opened))
            if depth and lowest:
                break
            depth += 1
    return out


def starting_states(chunks: DataFrame) -> DataFrame:
    """(source_file, block, number, quoted, depth, games): the state each chunk of a text catalog begins in, and the games opened before it.

    Files that begin with ``<`` are no text catalogs and have no rows.
    """
    kinds = "quoted array<boolean>, depth array<int>, end_quoted array<boolean>, end_depth array<int>, opened array<int>, markup boolean"

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [list(zip(*reports(text))) for text in batch["text"]]
            out = batch[["source_file", "block", "number"]].copy()
            for n, name in enumerate(("quoted", "depth", "end_quoted", "end_depth", "opened")):
                out[name] = [list(found[n]) for found in columns]
            out["markup"] = [text.lstrip().startswith("<") for text in batch["text"]]
            yield out

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        # A few numbers per chunk, however large the file.
        frame = frame.sort_values(["block", "number"])
        state, games, out = (False, 0), 0, []
        if frame["markup"].iloc[0]:
            return pd.DataFrame(out, columns=["source_file", "block", "number", "start_quoted", "start_depth", "games"])
        for row in frame.itertuples(index=False):
            out.append((row.source_file, row.block, row.number, state[0], state[1], games))
            known = {(bool(q), int(d)): (bool(e), int(f), int(o)) for q, d, e, f, o in
                     zip(row.quoted, row.depth, row.end_quoted, row.end_depth, row.opened)}
            most = max(d for q, d in known if q == state[0])
            inside, depth, opened = known[state[0], min(state[1], most)]
            state, games = (inside, depth + max(0, state[1] - most)), games + opened
        return pd.DataFrame(out, columns=["source_file", "block", "number", "start_quoted", "start_depth", "games"])

    return (chunks.mapInPandas(report, f"{_KEY}, {kinds}").groupBy("source_file")
            .applyInPandas(follow, f"{_KEY}, start_quoted boolean, start_depth int, games long"))


def split_point(text: str, quoted: bool, depth: int) -> int | None:
    """Where a chunk first stands outside of quoted texts and of blocks inside a game; None if nowhere."""
    if not quoted and depth <= 1:
        return 0
    word = None
    for kind, value, end, inside in tokens(text, quoted):
        before, word = word, None
        if kind == "(":
            depth += before is not None and (depth > 0 or before in GAMES)
        elif kind in (")", "rest"):
            depth = max(0, depth - (kind == ")"))
            # Behind a bracket or a quoted text no word waits for its value.
            if depth <= 1 and not inside:
                return end
        elif before is None or not depth:
            word = value if kind == "word" else None
    return None


def events(text: str, depth: int) -> Iterator[tuple[int, str, dict]]:
    """(games opened so far, kind, fields) of a text that begins between tokens at depth 0 or 1: records, and fields of games."""
    blocks: list[tuple[str, dict]] = [("game", {})] * depth
    word, opened = None, 0

    def close():
        kind, fields = blocks.pop()
        if len(blocks) == 1 and kind in RECORDS:
            yield opened, "record", fields

    for kind, value, _, _ in tokens(text, False):
        before, word = word, None
        if kind == "(":
            if before is not None and (blocks or before in GAMES):
                opened += not blocks
                blocks.append((before.lower(), {}))
        elif kind == ")":
            if blocks:
                yield from close()
        elif before is not None and blocks:
            field = value.replace('\\"', '"') if kind == "text" else value
            if len(blocks) == 1:
                yield opened, "game", {before.lower(): field}
            else:
                blocks[-1][1][before.lower()] = field
        elif kind == "word":
            word = value
    while blocks:
        yield from close()


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """Catalog records of chunks: source_file, position (in the file), name, rom_name, size, crc, md5, sha1, sha256 as they stand.

    The same rows as reading each file from its begin to its end. A file that breaks off yields what it held.
    """
    spark = chunks.sparkSession
    path = scratch_path(spark, "catalog-chunks")
    chunks.write.parquet(path)
    kept = spark.read.schema(chunks.schema).parquet(path)
    placed = kept.join(starting_states(kept), ["source_file", "block", "number"])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, block, number, text, quoted, depth, games in batch.itertuples(index=False):
                at = split_point(text, quoted, depth)
                if at != 0:
                    rows.append((source, block, number, text[:at], None, None, False))
                if at is not None:
                    # From a split point inside, one block is open: the game, which began before.
                    rows.append((source, block, number, text[at:], depth if at == 0 else _depth_at(text[:at], quoted, depth), games, True))
            yield pd.DataFrame(rows, columns=["source_file", "block", "number", "text", "depth", "games", "body"]).astype({"depth": "Int32", "games": "Int64"})

    parts = placed.select("source_file", "block", "number", "text", "start_quoted", "start_depth", "games").mapInPandas(
        part, f"{_KEY}, text string, depth int, games long, body boolean")
    path = scratch_path(spark, "catalog-parts")
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    # Each head goes to the last body before it; only places are sorted here, not texts.
    order = Window.partitionBy("source_file").orderBy("block", "number", "body")
    homes = parts.select("source_file", "block", "number", "body").withColumn(
        "home", F.last(F.when(F.col("body"), F.struct("block", "number")), ignorenulls=True).over(order))
    named = parts.join(homes, ["source_file", "block", "number", "body"]).select(
        "source_file", "home", "block", "number", "body", "text", "depth", "games")
    whole = named.groupBy("source_file", "home").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("body")).alias("later"), "block", "number", "text"))),
                                 lambda p: p["text"]), "").alias("text"),
        F.max("depth").alias("depth"), F.max("games").alias("games"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source_file", "block", "number", "game", "at", "kind", *FIELDS, "description"]
        for batch in batches:
            rows = []
            for source, block, number, text, depth, games in batch.itertuples(index=False):
                rows += [(source, block, number, games + opened, at, kind, *[fields.get(name) for name in (*FIELDS, "description")])
                         for at, (opened, kind, fields) in enumerate(events(text, depth))]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    kinds = ", ".join(f"{name} string" for name in (*FIELDS, "description"))
    found = whole.select("source_file", "home.block", "home.number", "text", "depth", "games").mapInPandas(
        read, f"{_KEY}, game long, at long, kind string, {kinds}")
    path = scratch_path(spark, "catalog-events")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    records = found.filter("kind = 'record'")
    place = F.struct("block", "number", "at")
    names = found.groupBy("source_file", "game").agg(
        F.count_if(F.col("kind") == "record").alias("records"),
        *[F.max_by(name, F.when((F.col("kind") == "game") & F.col(name).isNotNull(), place)).alias(f"game_{name}") for name in ("name", "description")])
    before = Window.partitionBy("source_file").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = records.groupBy("source_file", "block", "number").agg(F.count("*").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("source_file", "block", "number").orderBy("at")
    numbered = (records.withColumn("nth", F.row_number().over(within)).join(offsets, ["source_file", "block", "number"])
                .withColumn("position", F.col("offset") + F.col("nth") - 1))
    full = lookup_join(numbered, names, ["source_file", "game"], "records", "inner", salt_on=["position"])
    title = F.coalesce("game_name", "game_description", F.lit("Unknown"))
    return full.select(base_name(F.col("source_file")).alias("source_file"), "position", title.alias("name"),
                       F.coalesce("name", title).alias("rom_name"), "size", "crc", "md5", "sha1", "sha256")


def _depth_at(text: str, quoted: bool, depth: int) -> int:
    """The depth behind the beginning of a chunk that ends at its split point."""
    return walk(tokens(text, quoted), depth)[1]
