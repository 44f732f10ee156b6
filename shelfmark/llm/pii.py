"""Personal data replaced by keyed surrogates; DataFrame functions only.

Entities are found by one pattern. A surrogate is a function of a secret key and the
entity in its plain form (digits alone, lower-case address, bare name), so every mention
of one entity gets one surrogate, whatever its punctuation. Digits stay digits and
signs stay in place; addresses stay valid; names keep title, gender and script.
The distinct entities of the whole corpus are then checked: where two get the same
surrogate, or a surrogate is itself an entity of the corpus, the later one takes the next
attempt, until none collides. Texts are rewritten within their row by formula;
only the few entities that needed another attempt are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import settled, texts
from shelfmark.plans.skew import broadcast_if_small

# Titles by gender, given names by script and gender, syllables of family names by script.
TITLES = {"m": "Mr Herr Señor Monsieur Господин Κύριος", "f": "Mrs Ms Miss Frau Señora Madame Mme Госпожа Κυρία", "x": "Dr Prof"}
GIVEN = {
    "latin": {"m": "Adam Boris Carl David Emil Frank Georg Hugo", "f": "Alma Berta Clara Doris Elena Frida Greta Helga",
              "x": "Alex Robin Kim Noa Sascha Toni Jules Dana"},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл", "f": "Анна Вера Галина Дарья Елена Зоя Ирина Клара",
                 "x": "Саша Женя Валя Слава Никита Лёша Шура Тоша"},
    "greek": {"m": "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Νίκος", "f": "Άννα Βέρα Γεωργία Δάφνη Ελένη Ζωή Ιωάννα Κλειώ",
              "x": "Άρης Έλλη Ίλια Άλκη Ρένα Λένα Μίνα Τίνα"},
}
SYLLABLES = {"latin": "al ber con dor el fan gar hol in kas lem mor nes ott per ros",
             "cyrillic": "ал бер вор гар дон ел жан зор ин кас лем мор нес ост пер рос",
             "greek": "αλ βερ γον δορ ελ ζαν θορ ιν κασ λεμ μορ νεσ οττ περ ροσ σαλ"}
KEY = "change-me"
#: Attempts after which a corpus counts as unsettled.
ATTEMPTS = 12

_EVERY_TITLE = "|".join(" ".join(TITLES.values()).split())
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Letters of scripts that write no space between words (by code point, which is faster than by script), and what else an address may hold.
_GLUED = (r"\x{E01}-\x{E3A}\x{E40}-\x{E4E}\x{E50}-\x{E59}\x{E81}-\x{EDF}\x{1000}-\x{1049}\x{1050}-\x{109D}\x{1100}-\x{11FF}\x{1780}-\x{17D3}"
          r"\x{3005}-\x{3007}\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{318E}\x{31A0}-\x{31BF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}"
          r"\x{4E00}-\x{9FFF}\x{A960}-\x{A97C}\x{AC00}-\x{D7FB}\x{F900}-\x{FAFF}\x{FF66}-\x{FFDC}\x{20000}-\x{323AF}")
_SPACED = rf"[\x{{80}}-\x{{10FFFF}}&&[\p{{L}}\p{{M}}\p{{N}}]&&[^{_GLUED}]]"
_LOCAL = rf"[A-Za-z0-9._%+\-{_SPACED}]"
_ANY_LOCAL = r"[A-Za-z0-9._%+\-\p{L}\p{M}\p{N}]"
# An ASCII domain, which ends where letters of such scripts begin, or else one with any letters.
_DOMAIN = (rf"(?:[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})*\.[A-Za-z]{{2,24}}+(?!{_SPACED})"
           r"|[\p{L}\p{M}\p{N}-]{1,63}(?:\.[\p{L}\p{M}\p{N}-]{1,63})*\.[\p{L}\p{M}]{2,24})")
# Each pattern has its own boundary and fails on its first characters where nothing is to be found; quantifiers are possessive where they can be.
# An address begins where its run of characters does (or at the end of the entity before), or after a letter of a script without spaces.
# Words of ASCII letters alone, the most of many texts, never reach the costly classes.
EMAIL = (r"(?:(?:(?<![A-Za-z0-9._%+\-])|\G)(?=[A-Za-z0-9._%+\-]*+[@\x{80}-\x{10FFFF}])(?:(?<![\p{L}\p{M}\p{N}])|\G)"
         rf"{_LOCAL}*+(?:(?<={_LOCAL})|[{_GLUED}]{_ANY_LOCAL}*+(?<=[{_GLUED}]))"
         rf"|(?<=[\x{{80}}-\x{{10FFFF}}])(?<=[{_GLUED}]){_LOCAL}++)@{_DOMAIN}")
# A secret is the whole run after its keyword, without closing dots and equal signs before it; a run of signs alone is none.
SECRET = (r"(?<=[ =:\"])(?=[A-Za-z0-9_\-./+][A-Za-z0-9_\-./+=]{15})(?<=(?i:token|secret|password|api_key|apikey)[ =:\"]{1,4})"
          r"(?=[_\-./+=]*+[A-Za-z0-9])[A-Za-z0-9_\-./+=]{15,}[A-Za-z0-9_\-/+=](?![A-Za-z0-9_\-/+=])")
IP = rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9.]*[0-9])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SSN = r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])"
NAME = rf"(?:{_EVERY_TITLE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"
ENTITY = (rf"(?:{EMAIL}|{SECRET}|(?=[0-9+(])(?<![0-9])(?:{IP}|{CARD}|{SSN}|{PHONE})"
          rf"|(?=\p{{Lu}})(?<!\p{{L}}){NAME})")


def kind_of(entity: Column) -> Column:
    return (F.when(entity.contains("@"), "email").when(entity.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip")
            .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(entity.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), "card")
            .when(entity.rlike(r"^[+(0-9][0-9() .+-]+$"), "phone").when(entity.rlike(rf"^(?:{_EVERY_TITLE})\.? \p{{Lu}}"), "name")
            .otherwise("secret"))


def bare(entity: Column) -> Column:
    """The plain form that all mentions of an entity share, led by its kind."""
    kind = kind_of(entity)
    return F.concat(kind, F.lit(":"), F.when(kind.isin("ssn", "card", "phone"), F.regexp_replace(entity, "[^0-9]", ""))
                    .when(kind == "email", F.lower(entity))
                    .when(kind == "name", F.regexp_replace(entity, rf"^({_EVERY_TITLE})\.? ", "$1 ")).otherwise(entity))


def _seed(key: str, what: Column, attempt: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|"), what, F.lit("|"), attempt.cast("string")), 512)


def _number(seed: Column, at: Column | int, below: int) -> Column:
    """The number below ``below`` that three hex digits of the seed give, at a place that wraps around."""
    place = (F.lit(1) + F.pmod((at if isinstance(at, Column) else F.lit(at)) * 3, F.lit(126))).cast("int")
    return F.pmod(F.conv(F.substring(seed, place, F.lit(3)), 16, 10).cast("int"), F.lit(below))


def _letterwise(entity: Column, seed: Column) -> Column:
    """Each letter and digit replaced by another of its sort, letters beyond ASCII by ASCII letters; all else stays.

    One seed gives 42 numbers, so each further 42 letters have a seed of their own.
    """
    def one(first, c, n):
        own = F.when(n < 42, first).otherwise(F.sha2(F.concat(first, F.floor(n / 42).cast("string")), 512))
        pick = lambda letters: F.substring(F.lit(letters), _number(own, n, len(letters)) + 1, F.lit(1))
        return (F.when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike("^[a-f]$"), pick("abcdef"))
                .when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c.rlike(r"^[\p{L}\p{M}\p{N}]$"), pick("abcdefghijklmnopqrstuvwxyz"))
                .otherwise(c))
    # The seed is bound once, not made again for each letter.
    return F.transform(F.array(seed), lambda first: F.array_join(F.transform(F.split(entity, ""), lambda c, n: one(first, c, n)), ""))[0]


def _digits_filled(entity: Column, digits: Column) -> Column:
    """``digits`` put where ``entity`` has digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(
        F.concat(acc["out"], F.substring(digits, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(
        F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n")))
    return F.aggregate(F.split(entity, ""), start, step, lambda acc: acc["out"])


def _person(entity: Column, key: str, attempt: Column) -> Column:
    title = F.regexp_extract(entity, rf"^((?:{_EVERY_TITLE})\.?) ", 1)
    words = F.split(F.regexp_replace(entity, rf"^(?:{_EVERY_TITLE})\.? ", ""), " ")
    gender = F.when(title.rlike(rf"^({TITLES['m'].replace(' ', '|')})\.?$"), "m").when(
        title.rlike(rf"^({TITLES['f'].replace(' ', '|')})\.?$"), "f").otherwise("x")
    rest = F.array_join(words, " ")
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").when(rest.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    # A name that has to move takes another given name, so that its family stays that of the other mentions; only a lone family name moves itself.
    family = _seed(key, F.concat(F.lit("family:"), F.element_at(words, -1)), F.when(F.size(words) > 1, F.lit(0)).otherwise(attempt))
    first = _seed(key, F.concat(F.lit("given:"), words[0]), attempt)

    def choose(options):
        chosen = None
        for name, value in options:
            chosen = F.when(name, value) if chosen is None else chosen.when(name, value)
        return chosen

    surname = choose([(script == s, F.initcap(F.concat(*[
        F.element_at(F.array(*map(F.lit, SYLLABLES[s].split())), _number(family, n, 16) + 1) for n in range(4)]))) for s in SYLLABLES])
    given = choose([((script == s) & (gender == g), F.element_at(F.array(*map(F.lit, GIVEN[s][g].split())), _number(first, 0, 8) + 1))
                    for s in GIVEN for g in "mfx"])
    # Later attempts draw given names from a space of 8 x 16^3, so one family may have any usual number of members.
    longer = choose([(script == s, F.concat(*[F.element_at(F.array(*map(F.lit, SYLLABLES[s].split())), _number(first, n, 16) + 1) for n in (1, 2, 3)]))
                     for s in SYLLABLES])
    return F.concat_ws(" ", title, F.when(F.size(words) > 1, F.when(attempt > 0, F.concat(given, longer)).otherwise(given)), surname)


def surrogate(entity: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of one mention, in the mention's own format."""
    kind, seed = kind_of(entity), _seed(key, bare(entity), attempt)
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(F.regexp_replace(entity, "[^0-9]", "")))),
                                      lambda n: _number(seed, n, 10).cast("string")), "")
    address = F.concat(_letterwise(F.lower(F.substring_index(entity, "@", 1)), seed), F.lit("@mail"), F.substring(seed, 100, 8), F.lit(".example"))
    return (F.when(kind == "email", address)
            .when(kind == "ip", F.concat_ws(".", *[_number(seed, n, 256).cast("string") for n in range(4)]))
            .when(kind.isin("ssn", "card", "phone"), _digits_filled(entity, digits))
            .when(kind == "name", _person(entity, key, attempt))
            .otherwise(_letterwise(entity, seed)))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def later_attempts(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(plain, attempt) of the entities whose first surrogate collides; every other entity keeps attempt 0.

    One mention stands for an entity; counts and collisions are of plain forms, by
    aggregations over the distinct entities of all documents.
    """
    plain = (texts(docs).select(F.explode(mentions(F.col("text"))).alias("mention"))
             .groupBy(bare(F.col("mention")).alias("plain")).agg(F.min("mention").alias("mention")))
    state = settled(plain.withColumn("attempt", F.lit(0)))
    real = state.select(F.col("plain").alias("real"))
    for _ in range(ATTEMPTS):
        made = state.withColumn("made", bare(surrogate(F.col("mention"), F.col("attempt"), key)))
        rank = F.row_number().over(Window.partitionBy("made").orderBy("plain"))
        clash = settled(made.withColumn("nth", rank).join(real, F.col("made") == F.col("real"), "left")
                        .filter("nth > 1 OR real IS NOT NULL").select("plain"))
        if clash.isEmpty():
            return state.filter("attempt > 0").select("plain", "attempt")
        hit = clash.distinct().withColumn("hit", F.lit(1))
        state = settled(state.join(hit, "plain", "left").select(
            "plain", "mention", (F.col("attempt") + F.coalesce("hit", F.lit(0))).alias("attempt")))
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts")


def _with_attempts(plain: DataFrame, again: DataFrame) -> DataFrame:
    """Adds ``attempts`` (mention → attempt) to the documents that hold an entity of ``again``."""
    held = (plain.select("doc_id", F.explode(F.array_distinct("found")).alias("mention")).withColumn("plain", bare(F.col("mention")))
            .join(broadcast_if_small(again), "plain").dropDuplicates(["doc_id", "mention"])
            .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("mention", "attempt"))).alias("attempts")))
    return plain.join(broadcast_if_small(settled(held)), "doc_id", "left")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_entities, kinds (sorted, comma-joined), text with surrogates.

    A null or empty text gives an empty one without entities. Rows that repeat a doc_id
    are rewritten each, alike. No rows give no rows; further columns are ignored.
    """
    again = settled(later_attempts(docs, key))
    plain = texts(docs).withColumn("found", mentions(F.col("text")))
    none = F.lit(None).cast("map<string,int>")
    plain = plain.withColumn("attempts", none) if again.isEmpty() else _with_attempts(plain, again)
    own = lambda mention: surrogate(mention, F.coalesce(F.element_at("attempts", mention), F.lit(0)), key)
    between = F.split("text", ENTITY, -1)
    pieces = F.zip_with(between, F.transform("found", own), lambda text, made: F.concat(text, F.coalesce(made, F.lit(""))))
    return plain.select(
        "doc_id", F.size("found").cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", kind_of))), ",").alias("kinds"),
        F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"))


def op6_pii_surrogates(docs: DataFrame) -> DataFrame:
    return replace(docs)
