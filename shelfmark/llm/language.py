"""Language identification with blended-spectrum presence kernels.

k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), G being the set of hashed character
n-grams of lengths 1 to 3 in a text. Landmarks give the Nyström features
K(x, Z) K(Z, Z)^(-1/2), on which one ridge regression per language is solved in closed
form. Landmarks and training rows are a bounded sample of labelled rows
(``landmarks`` and ``rows`` per language, by hash of doc_id); prediction reads every
whole text and is a matrix product per batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import texts

#: Landmarks and training rows for each language, and the most languages that are learned.
LANDMARKS, ROWS, LANGUAGES = 40, 600, 200
#: Hash buckets of n-grams, their longest length, the ridge, documents in a matrix product.
BUCKETS, LONGEST, RIDGE, BATCH = 2**13, 3, 1e-2, 256
UNKNOWN = "und"


def presence(texts_: list[str]) -> np.ndarray:
    """One row per text: 1 where an n-gram of the lower-cased text falls."""
    out = np.zeros((len(texts_), BUCKETS), np.float32)
    for row, text in enumerate(texts_):
        # In blocks, so that a very long text needs little memory; blocks overlap by the longest n-gram.
        lowered = text.lower()
        for begin in range(0, len(lowered), 1 << 20):
            codes = np.frombuffer(lowered[begin:begin + (1 << 20) + LONGEST - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            value = np.zeros(len(codes), np.uint32)
            for n in range(LONGEST):
                if len(codes) <= n:
                    break
                value = (value[:len(codes) - n] + codes[n:]) * np.uint32(0x9E3779B1)
                out[row, (value ^ (value >> np.uint32(15))) >> np.uint32(3) & np.uint32(BUCKETS - 1)] = 1
    return out


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(1, rows.sum(axis=1)))[:, None] * np.sqrt(np.maximum(1, landmarks.sum(axis=1)))[None]
    return rows @ landmarks.T / sizes


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def training_rows(docs: DataFrame, each: int) -> DataFrame:
    """(lang, text, nth): at most ``each`` rows of each language, of documents that are not held out.

    The rank is taken first within 64 parts of a language and then among their best,
    so no task holds a whole language, and only doc_id and lang are sorted.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").filter(
        "doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = known.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = part.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("nth") <= each)
    best = first.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("nth") <= each)
    chosen = best.select("doc_id", F.col("lang").alias("label"), "nth").limit(each * LANGUAGES)
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("label", "text", "nth", "doc_id")


class Model:
    def __init__(self, languages, landmarks, weights):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def predict(self, texts_):
        """(languages, scores from 0 to 1): the best one-versus-rest output and its margin over the next."""
        out = kernel(presence(texts_), self.landmarks) @ self.weights
        best = out.argmax(axis=1)
        ordered = np.sort(out, axis=1)
        margin = ordered[:, -1] - (ordered[:, -2] if out.shape[1] > 1 else -1.0)
        return [self.languages[n] for n in best], np.clip(margin / 2, 0, 1).astype(float)


def fit(docs: DataFrame, landmarks: int = LANDMARKS, rows: int = ROWS) -> Model | None:
    """The model, or None without a labelled row. At most ``rows`` packed rows per language reach the driver."""
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            bits = [np.packbits(presence([text])[0] > 0).tobytes() for text in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "nth": frame["nth"], "doc_id": frame["doc_id"], "bits": bits})

    got = training_rows(docs, rows).mapInPandas(run, "label string, nth int, doc_id long, bits binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["label", "nth", "doc_id"], ignore_index=True)
    data = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    languages = sorted(got["label"].unique())
    marks = data[(got["nth"] <= landmarks).to_numpy()]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6)))
    features = kernel(data, marks) @ root
    targets = np.where(got["label"].to_numpy()[:, None] == np.asarray(languages, object)[None], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + RIDGE * len(data) * np.eye(features.shape[1]) / 100, features.T @ targets)
    return Model(languages, marks, (root @ solved).astype(np.float32))


def predict(docs: DataFrame, landmarks: int = LANDMARKS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0; so is every text
    where nothing can be learned. A null doc_id is not held out and never learned
    from. Rows that repeat a doc_id are predicted each; further columns are ignored.
    """
    model = fit(docs, landmarks, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        model = shared.value
        for frame in frames:
            for begin in range(0, len(frame), BATCH):
                some = frame.iloc[begin:begin + BATCH]
                names, scores = model.predict(list(some["text"])) if model else ([UNKNOWN] * len(some), np.zeros(len(some)))
                letters = [any(map(str.isalpha, text)) for text in some["text"]]
                yield pd.DataFrame({"doc_id": some["doc_id"], "held_out": some["held_out"],
                                    "lang_pred": [n if known else UNKNOWN for n, known in zip(names, letters, strict=True)],
                                    "score": np.where(letters, scores, 0.0)})

    rows_ = texts(docs).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return rows_.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(docs: DataFrame) -> DataFrame:
    return predict(docs)
