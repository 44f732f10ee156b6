"""Toxicity grades by cumulative-link (proportional-odds) regression.

Grades are ordered: 0 clean, 1 toxic, 2 severely toxic. The labels say toxic or
not; toxic training rows are split at the median amount of words tied to toxic
rows into grades 1 and 2. All thresholds share one weight vector over sparse text
features, P(grade >= k) = sigmoid(w x - t_k), and the expected severity is the sum of
these probabilities. The model is fit on a bounded sample of labelled rows
(``sample``, by hash of doc_id); scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import settled, texts
from shelfmark.plans.skew import broadcast_if_small

#: Labelled rows the model is fit on, features it keeps, hash buckets of features.
SAMPLE, FEATURES, BUCKETS = 20_000, 4_000, 2**20
#: Besides whole words, word beginnings of these many letters.
BEGINNINGS = (5, 6, 7)
#: A feature stands in this many sampled documents at least, and its two shares differ by this many standard errors.
LEAST_DOCUMENTS, LEAST_Z = 5, 4.0
#: From this probability of a grade above 0 on a document is rejected.
REJECT = 0.5


def feature_ids(word: str) -> tuple[int, ...]:
    import zlib

    parts = [f"={word}"] + [word[:n] for n in BEGINNINGS if len(word) > n]
    return tuple(zlib.crc32(part.encode()) % BUCKETS for part in parts)


class Columns(dict):
    """word → model columns of its features, remembered."""

    def __init__(self, columns):
        super().__init__()
        self.columns = columns

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        ids = feature_ids(word)
        value = self[word] = ids if self.columns is None else tuple(self.columns[i] for i in ids if i in self.columns)
        return value


def counted(text: str, known: Columns) -> tuple[np.ndarray, np.ndarray, int]:
    """(columns, counts, words) of one text."""
    import re

    words = re.findall(r"\w+", text.lower())
    found = [i for ids in map(known.__getitem__, words) if ids for i in ids]
    columns, counts = np.unique(np.asarray(found, np.int64), return_counts=True)
    return columns, counts, len(words)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled documents; the join's small side has that many rows."""
    chosen = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def choose_features(rows: DataFrame, features: int) -> list[int]:
    """The buckets whose document shares differ most between toxic and clean rows."""
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        known, totals = Columns(None), np.zeros((2, BUCKETS), np.int32)
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                totals[int(toxic > 0), counted(text, known)[0]] += 1
        at = np.flatnonzero(totals.any(axis=0))
        if len(at):
            yield pd.DataFrame({"bucket": at, "clean": totals[0, at], "toxic": totals[1, at]})

    sizes = {r.toxic: r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    clean, toxic = max(1, sizes.get(False, 0)), max(1, sizes.get(True, 0))
    both = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(both * (1 - both) * (1 / toxic + 1 / clean) + F.lit(1e-12))
    sums = rows.select("text", "toxic").mapInPandas(run, "bucket long, clean int, toxic int").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = (sums.filter(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS).withColumn("z", z)
            .filter(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "bucket").limit(features))
    return [r.bucket for r in best.collect()]


class Model:
    """Columns, weights, two thresholds; probabilities of grade >= 1 and >= 2."""

    def __init__(self, columns, weights, thresholds, scale):
        self.columns, self.weights, self.thresholds, self.scale = columns, weights, thresholds, scale

    def score(self, columns, counts, words):
        value = float(self.weights[columns] @ np.sqrt(counts)) + self.weights[-1] * (np.log1p(words) - self.scale)
        return 1 / (1 + np.exp(-np.clip(value - self.thresholds, -40, 40)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows, columns, values, extra, grades, width, rounds=400, rate=0.1, ridge=1e-4):
    """Maximum likelihood of the cumulative-link model by full-batch Adam on sparse rows; (weights, thresholds)."""
    count = len(grades)
    weights, thresholds = np.zeros(width + 1), np.array([1.0, 2.0])
    moments = [np.zeros(width + 3), np.zeros(width + 3)]
    for step in range(1, rounds + 1):
        value = np.bincount(rows, weights[columns] * values, count) + weights[-1] * extra
        p1, p2 = sigmoid(value - thresholds[0]), sigmoid(value - thresholds[1])
        # d log-likelihood / d value and / d thresholds, grade by grade
        middle = np.maximum(p1 - p2, 1e-9)
        d1, d2 = p1 * (1 - p1), p2 * (1 - p2)
        by_first = np.where(grades == 0, p1, np.where(grades == 1, -d1 / middle, 0.0))
        by_second = np.where(grades == 1, d2 / middle, np.where(grades == 2, -(1 - p2), 0.0))
        slope = -(by_first + by_second)
        gradient = np.concatenate([np.bincount(columns, slope[rows] * values, width) / count - ridge * weights[:-1],
                                   [slope @ extra / count - ridge * weights[-1]],
                                   [by_first.sum() / count, by_second.sum() / count]])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weights, thresholds = weights + move[:-2], np.sort(thresholds + move[-2:])
    return weights, thresholds


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model | None:
    """The model, or None where the labels hold no toxic or no clean row."""
    rows = labelled_sample(docs, labels, sample)
    chosen = choose_features(rows, features)
    columns = {bucket: n for n, bucket in enumerate(chosen)}

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        known = Columns(columns)
        for frame in frames:
            made = [counted(text, known) for text in frame["text"]]
            yield pd.DataFrame({"toxic": frame["toxic"], "words": [m[2] for m in made],
                                "columns": [m[0].astype(np.int32) for m in made], "counts": [m[1].astype(np.int32) for m in made]})

    # At most ``sample`` rows of chosen columns only come to the driver.
    got = rows.select("text", "toxic", "doc_id").orderBy("doc_id").select("text", "toxic").mapInPandas(
        run, "toxic int, words int, columns array<int>, counts array<int>").toPandas()
    toxic = got["toxic"].to_numpy() > 0
    if not len(got) or toxic.all() or not toxic.any() or not chosen:
        return None
    sizes = got["columns"].map(len).to_numpy()
    index = np.repeat(np.arange(len(got)), sizes)
    flat, counts = (np.concatenate([np.asarray(x) for x in got[c]]).astype(float) for c in ("columns", "counts"))
    flat, words = flat.astype(np.int64), got["words"].to_numpy(float)
    share = np.bincount(flat, toxic[index], len(chosen)) / np.maximum(1, np.bincount(flat, minlength=len(chosen)))
    tied = share > 0.5 + toxic.mean() / 2
    amount = np.bincount(index, np.sqrt(counts) * tied[flat], len(got))
    grades = np.where(toxic, 1 + (amount > np.median(amount[toxic])), 0)
    scale = float(np.log1p(words).mean())
    weights, thresholds = fit_ordinal(index, flat, np.sqrt(counts), np.log1p(words) - scale, grades, len(chosen))
    return Model(columns, weights, thresholds, scale)


def mark(docs: DataFrame, labels: DataFrame, reject: float = REJECT, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, toxic, p_toxic, p_severe, severity (expected grade, 0 to 2).

    A null or empty text is clean with severity 0; so is every text if the labels
    hold no toxic or no clean row. Rows that repeat a doc_id are scored each.
    Further columns are ignored.
    """
    model = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        model = shared.value
        known = Columns(model.columns if model else {})
        for frame in frames:
            rows = []
            for text in frame["text"]:
                columns, counts, words = counted(text, known)
                rows.append(model.score(columns, counts, words) if model and words else (0.0, 0.0))
            odds = np.asarray(rows, float).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": odds[:, 0] >= reject, "p_toxic": odds[:, 0],
                                "p_severe": odds[:, 1], "severity": odds.sum(axis=1)})

    return texts(docs).mapInPandas(run, "doc_id long, toxic boolean, p_toxic double, p_severe double, severity double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; a doc_id goes if one of its rows is rejected."""
    gone = settled(mark(docs, labels).filter("toxic").select("doc_id").distinct())
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mark(docs, labels)
