"""Decontamination, licences, toxicity, language and surrogates."""

import itertools
import re

import numpy as np
import pytest

from shelfmark.llm import decontamination, language, licenses, pii, toxicity

FOLDER = "/root/testdata/sf0.01"


def brute_overlap(text, item, least, share):
    words = lambda t: [w for w in (c.strip(decontamination.SIGNS).lower() for c in (t or "").split()) if w]
    doc, test = words(text), words(item)
    for diagonal in range(-len(test) + 1, len(doc)):
        low, high = max(0, -diagonal), min(len(test), len(doc) - diagonal)
        equal = [doc[i + diagonal] == test[i] for i in range(low, high)]
        for i in range(len(equal)):
            for j in range(i + 1, len(equal) + 1):
                if j - i >= min(least, len(test)) and sum(equal[i:j]) >= share * (j - i) - 1e-9:
                    return True
    return False


def test_decontamination_finds_replaced_words_and_leaves_others(spark):
    item = "the quick brown fox jumps over a lazy dog while seven wise owls watch quietly from old trees"
    words = item.split()
    replaced = " ".join("XX" if n % 6 == 5 else w for n, w in enumerate(words))
    rows = [(1, item), (2, "pre " + replaced.upper() + " post"), (3, " ".join(words[:9])), (4, None), (5, ""), (6, "| " .join(words[2:16])),
            (7, " ".join(reversed(words))), (8, "say hello big world now"), (9, "q " * 5000 + item), (1, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as seed", "3 as item_id")
    items = spark.createDataFrame([(10, item), (11, "hello big world"), (12, None), (13, "x")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontamination.mark(docs, items).collect()}
    want = {n: any(brute_overlap(text, test, 13, 0.8) for test in (item, "hello big world")) for n, text in rows if n != 9} | {9: True}
    assert got == want and want[2] and want[6] and not want[3] and not want[7]
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [3, 4, 5, 7]
    assert decontamination.mark(docs.limit(0), items).count() == 0
    assert not decontamination.mark(docs, items.limit(0)).filter("contaminated").count()


def test_a_task_holds_little_of_a_batch_in_arrays(monkeypatch):
    """Hits of one batch of 4 MB: the same in rounds of any size, and arrays of far less than the batch takes as a whole."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    taken = []
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda bitmap: SimpleNamespace(value=bitmap))),
                           mapInArrow=lambda run, schema: taken.append(run))
    docs.filter = lambda condition: docs
    rng = np.random.default_rng(9)
    words = np.array([f"word{n}" for n in range(5000)])
    texts = [" ".join(words[rng.integers(0, len(words), 350)]) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    bitmap = rng.integers(0, 256, 1 << 17, dtype=np.uint8) & rng.integers(0, 256, 1 << 17, dtype=np.uint8) & 17

    def hits():
        decontamination.document_hits(docs, bitmap, decontamination.MASKS)
        return pa.Table.from_batches(taken[-1](iter([batch]))).to_pandas().sort_values(["doc_id", "pos", "seed"]).to_numpy()

    small = hits()
    tracemalloc.start()
    for _ in taken[-1](iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(decontamination, "ROUND", 4 << 20)
    assert len(small) and np.array_equal(small, hits()) and peak < 16 << 20


def hit(masks, equal):
    return any(all(equal[at + n] for n, bit in enumerate(mask) if bit == "1")
               for mask in masks for at in range(len(equal) - len(mask) + 1))


@pytest.mark.parametrize(("least", "share"), [(13, 0.8), (13, 0.9), (8, 0.7)])
def test_masks_hit_every_accepted_overlap(least, share):
    # Whole short items, and the stretches that every longer accepted overlap holds.
    for length in range(decontamination.SHORTEST_ITEM, 21 if share >= 0.8 else 16):
        masks = decontamination.masks_hitting(min(length, least), least, share)
        replaced = int((1 - share) * length + 1e-9)
        for gone in itertools.combinations(range(length), replaced):
            assert hit(masks, [n not in gone for n in range(length)]), (length, gone)


def test_decontamination_of_short_items_with_each_word_replaced(spark):
    items = {n: [f"item{n}word{k}" for k in range(n)] for n in range(3, 13)} | {15: [f"long{k}" for k in range(15)]}
    docs, want = [], {}
    for n, words in items.items():
        for count in range(4):
            for gone in itertools.combinations(range(n), count):
                want[len(docs)] = n - count >= 0.8 * n - 1e-9 or n == 15 and count <= 3
                docs.append((len(docs), "a b " + " ".join("zz" if k in gone else w for k, w in enumerate(words)) + " c"))
    got = decontamination.mark(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame([(n, " ".join(words)) for n, words in items.items()], "item_id long, text string"))
    assert {r.doc_id: r.contaminated for r in got.collect()} == want


def test_longest_stretch_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        equal = rng.random(rng.integers(0, 30)) < 0.7
        best = max((j - i for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if equal[i:j].sum() >= 0.8 * (j - i) - 1e-9), default=0)
        start, length = decontamination.longest_stretch(equal, 0.8)
        assert length == best and (not length or equal[start:start + length].sum() >= 0.8 * length - 1e-9)


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_equal_brute_force(spark):
    notice = licenses.NOTICES[0][0]
    edited = notice.replace("any person", "any other person")
    rows = [(1, "The MIT-License, mit license; Apache  License MIT"), (2, None), (3, ""), (4, "GNU General Public License Apache license"),
            (5, "x " + edited + " y"), (6, "mit\nlicense " * 50), (7, "général public licenseé general public"), (8, " ".join(notice.split()[:6]))]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").selectExpr("*", "'z' as label", "1 as gram").repartition(3)
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert tuple(r)[1:6] == base_places(dict(rows)[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {r.doc_id: r.labels for r in got}
    assert labels[5] == "mit" and labels[8] == ""
    corpus = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert all(tuple(r)[1:6] == base_places(texts[r.doc_id]) for r in licenses.scan(corpus).collect())
    assert licenses.scan(docs.limit(0)).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language.predict(docs.withColumn("label", docs["lang"])).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_rows(spark):
    rows = [(n, "der die das und nicht " * 4, "de") for n in range(12)] + [(n, "the of and that with " * 4, "en") for n in range(20, 32)]
    rows += [(50, None, "de"), (51, "12 34 !!", "en"), (52, "", None), (None, "the and of", "en"), (53, "und nicht das", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(docs).collect()}
    assert [got[n] for n in (50, 51, 52, None, 53)] == ["und", "und", "und", "en", "de"]
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.predict(unlabelled).collect()} == {"und"}
    assert language.predict(docs.limit(0)).count() == 0


def test_toxicity_on_rows_it_has_not_seen(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    got = toxicity.mark(docs.withColumn("toxic", docs["doc_id"]), half).join(
        labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").collect()
    clean = [r for r in got if not r.label]
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean)
    assert sum(r.toxic for r in got if r.label) >= 0.5 * sum(r.label for r in got)
    assert all(0 <= r.p_severe <= r.p_toxic <= 1 and abs(r.severity - r.p_toxic - r.p_severe) < 1e-9 for r in got)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (None, "c"), (3, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 1), (None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        assert [r.severity for r in toxicity.mark(docs, known).collect()] == [0.0] * 5
        assert toxicity.drop_toxic(docs, known).count() == 5
    assert toxicity.mark(docs.limit(0), labels).count() == 0


PERSONAL = [
    (1, "Call +1 (017) 555-7713, again +1 (017) 555-7713; card 9807915762804490 or 9807 9157 6280 4490."),
    (2, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" at 97.51.17.173 from a.b@mail7.example.com, A.B@mail7.example.com'),
    (3, "Mr. John Smith met Frau Anna Müller, Mr. Smith and Господин Иван Петров. ssn 123-45-6789"),
    (4, None), (5, ""), (6, "Version 3.0 of 12 things, 4.0 left"), (7, "192.168.0.1 " * 300),
]


def test_surrogates_keep_format_and_identity(spark):
    docs = spark.createDataFrame([*PERSONAL, PERSONAL[0]], "doc_id long, text string").selectExpr("*", "1 as found", "2 as attempts", "'k' as plain")
    rows = {r.doc_id: r for r in pii.replace(docs).collect()}
    assert {n: r.n_entities for n, r in rows.items()} == {1: 4, 2: 4, 3: 5, 4: 0, 5: 0, 6: 0, 7: 300}
    phone = re.findall(r"\+\d \(\d{3}\) \d{3}-\d{4}", rows[1].text)
    cards = [re.sub(" ", "", c) for c in re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", rows[1].text)]
    assert len(set(phone)) == 1 and len(phone) == 2 and cards[0] == cards[1] != "9807915762804490"
    assert re.search(r'token = "[0-9a-f]{40}"', rows[2].text) and "04dbebab" not in rows[2].text
    assert len(set(re.findall(r"\S+@\S+\.example", rows[2].text.replace(",", "")))) == 1
    names = re.match(r"Mr\. (\w+) (\w+) met Frau (\w+) (\w+), Mr\. (\w+) and Господин (\w+) (\w+)", rows[3].text)
    assert names[1] in pii.GIVEN["latin"]["m"] and names[3] in pii.GIVEN["latin"]["f"] and names[6] in pii.GIVEN["cyrillic"]["m"]
    assert names[2] == names[5] and rows[6].text == PERSONAL[5][1] and rows[4].text == rows[5].text == ""
    assert len(set(rows[7].text.split())) == 1
    assert pii.replace(docs, "other").filter("doc_id = 1").first().text != rows[1].text
    assert pii.replace(docs.limit(0)).count() == 0


def test_entities_glued_to_letters_are_replaced(spark):
    card, mail, phone, ip = "9807915762804490", "abc@mail.example.com", "017-555-7713", "97.51.17.173"
    before = ["电话", "メール", "カード", "โทร", "card", "и", "卡号：", "이메일"]
    rows = [(n, f"{word}{card}。{word}{phone}。{word}{ip}。") for n, word in enumerate(before)]
    rows += [(50 + n, f"{word}{mail}电话") for n, word in enumerate(before)]
    odd = ["müller@firma.de", "JOSÉ.Núñez@firma.de", "иван@почта.рф", "用户@例子.com", "x.y@bücher.de", f"{card}abc@firma.de", "(017) 555-7713abc@firma.de",
           "a" * 80 + "@firma.de", "abc@mail.firmaü.de"]
    rows += [(100 + n, f"an {text} zu") for n, text in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(docs).collect()}
    for n, word in enumerate(before):
        r, m = got[n], got[50 + n]
        assert r.kinds == "card,ip,phone" and r.n_entities == 3 and r.text.startswith(word), word
        assert not any(x in r.text for x in (card, phone, ip))
        assert m.kinds == "email" and "abc@" not in m.text and m.text.endswith(".example电话"), word
    same = {got[50 + n].text.removeprefix(word) for n, word in enumerate(before) if word not in ("card", "и")}
    assert len(same) == 1
    for n, text in enumerate(odd):
        r = got[100 + n]
        assert "email" in r.kinds and r.text.endswith(".example zu") and r.text.startswith("an "), text
        assert not any(x in r.text for x in ("firma", "bücher", "почта", "例子", "ü", "é", "ñ", "иван", "用户", "555")), r.text


def test_secrets_are_replaced_whole(spark):
    long = "".join("0123456789abcdefXYZ"[i * i % 19] for i in range(400))
    secrets = ["9233A8EC04DBEBAB91AB85687D33EEAA", "ab/cd+EF0123456789xyz==", "/+abcdEF0123456789xyz", "eyJhbGciOi9.eyJzdWIiOiIx9.SflKxwRJSMe9", long,
               "9807915762804490abcdefgh"]
    rows = [(10 * n + k, f'{word}{secret}{end}') for n, secret in enumerate(secrets)
            for k, (word, end) in enumerate([('TOKEN = "', '" x'), ("Password: ", ". X"), ("api_key=", "\nx")])]
    rows += [(100, "password: ...................... and SECRET ====================="), (101, "Password: ____________________")]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, secret in enumerate(secrets):
        for k, (word, end) in enumerate([('TOKEN = "', '" x'), ("Password: ", ". X"), ("api_key=", "\nx")]):
            r = got[10 * n + k]
            made = r.text.removeprefix(word).removesuffix(end)
            assert r.n_entities == 1 and len(r.text) == len(word + secret + end) and len(made) == len(secret), (secret, r)
            assert not any(secret[i:i + 8] in r.text for i in range(len(secret) - 7)), (secret, r)
            assert [c for c in made if not c.isalnum()] == [c for c in secret if not c.isalnum()]
            assert made == got[10 * n].text[9:9 + len(secret)]
    assert [got[n].text for n in (100, 101)] == [text for n, text in rows if n >= 100]


def test_colliding_surrogates_stay_distinct(spark, monkeypatch):
    # Ten short given names for one family: eight surrogates, so some need another attempt.
    docs = spark.createDataFrame([(n, f"Mr Tom{c} Lee and Mr Tom{c} Lee") for n, c in enumerate("abcdefghij")], "doc_id long, text string")
    texts = [r.text for r in pii.replace(docs).collect()]
    assert len(set(texts)) == 10 and all(a == b for a, b in (t.split(" and ") for t in texts))
    assert pii.later_attempts(docs).count() > 0


@pytest.mark.parametrize("grade_cut", [1.0])
def test_ordinal_fit_orders_grades(grade_cut):
    rng = np.random.default_rng(0)
    severity = rng.integers(0, 3, 600)
    rows = np.repeat(np.arange(600), severity)
    columns = np.zeros(len(rows), np.int64)
    weights, thresholds = toxicity.fit_ordinal(rows, columns, np.ones(len(rows)), np.zeros(600), severity, 1)
    assert weights[0] > grade_cut and thresholds[0] < thresholds[1]


def test_one_family_name_with_many_members(spark):
    """More members than there are given names: all stay distinct, and all mentions of the family keep one name."""
    rows = [(n, f"Mr A{'bcdfghjklm'[n % 10]}{'aeiou'[n // 10 % 5]}{'lmnrst'[n // 50 % 6]} Lee and Mr Lee") for n in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = [r.text for r in pii.replace(docs).collect()]
    assert len({text.split(" and ")[0] for text in texts}) == 250
    families = {word for text in texts for word in (text.split(" and ")[0].split()[-1], text.split()[-1])}
    assert len(families) == 1 and "Lee" not in families
