"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the character n-grams (1 to 3)
that both contain, divided by the root of the product of their numbers.  Landmark texts of
each language give a Nyström map; one-versus-rest kernel ridge regression is solved on it.
As the kernel is linear in the presence vectors, map and weights fold into one matrix, and a
batch of documents is scored by one matrix product.

n-grams are hashed to ``DIMENSIONS`` places; letters are lower-cased, all else counts as one space.
The model is fitted on at most ``PER_LANGUAGE`` texts of each language, in the order of a hash of
their id.  A text that is null or has no letter is ``und`` with score 0; so is every text if
nothing can be learned.  Equal margins go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placemetrics.llm.common import documents, remainder

DIMENSIONS = 1 << 13
#: Texts of each language that the model is fitted on, and those that are landmarks, at most.
PER_LANGUAGE, LANDMARKS = 400, 32
RIDGE = 1e-2
#: Characters handled at once; the last two are carried over.
BLOCK = 1 << 20
#: Documents of one matrix product.
BATCH = 256
UNKNOWN = "und"
#: Parts that the candidates of a language are first ranked in.
SALTS = 64


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def _place(codes: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(codes) - n + 1, n, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - 13)


def presence(text: str) -> np.ndarray:
    """Which places the n-grams of the whole text take."""
    seen = np.zeros(DIMENSIONS, bool)
    carried = np.array([32], np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "replace"), np.uint32)
        letters = (codes >= 1 << 16) | _letters()[np.minimum(codes, 0xFFFF)]
        codes = np.r_[carried, np.where(letters, codes, np.uint32(32))]
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
        for n in (1, 2, 3):
            if len(codes) >= n:
                seen[_place(codes, n)] = True
        carried = codes[-2:]
    if carried[-1] != 32:  # the last word ends like the others
        codes = np.r_[carried, np.uint32(32)]
        for n in (2, 3):
            if len(codes) >= n:
                seen[_place(codes, n)] = True
    return seen


@dataclass
class KernelModel:
    """Languages, and the matrix that takes normed presence vectors to their margins."""

    languages: list[str]
    weights: np.ndarray

    def margins(self, seen: np.ndarray) -> np.ndarray:
        rows = seen.astype(np.float32)
        return (rows @ self.weights) / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def fit(seen: np.ndarray, languages: list[str]) -> KernelModel:
    """One-versus-rest ridge regression on the Nyström features of the rows of ``seen``."""
    names = sorted(set(languages))
    if not names:
        return KernelModel([], np.zeros((DIMENSIONS, 0), np.float32))
    labels = np.array([names.index(x) for x in languages])
    normed = seen.astype(np.float32)
    normed /= np.sqrt(np.maximum(normed.sum(1, keepdims=True), 1))
    landmarks = normed[np.concatenate([np.flatnonzero(labels == k)[:LANDMARKS] for k in range(len(names))])]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = (normed @ landmarks.T).astype(np.float64) @ root
    targets = np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (1 / np.bincount(labels, minlength=len(names)))[labels][:, None]
    ridge = RIDGE * len(names) / max(1, z.shape[1]) * np.eye(z.shape[1])
    solved = np.linalg.solve(z.T @ (weight * z) + ridge, z.T @ (weight * targets))
    return KernelModel(names, (landmarks.T @ (root @ solved)).astype(np.float32))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> KernelModel:
    """Fit on texts with a language whose id is not held out."""
    usable = docs.filter("lang is not null and text is not null").filter(remainder("doc_id", 3) != 1)
    order = (F.xxhash64("doc_id"), "doc_id")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    # at most SALTS * per_language rows of a language meet, whatever the number of its texts and of tasks
    some = usable.select("doc_id", "lang", salt.alias("salt")).withColumn(
        "n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("n") <= per_language)
    ids = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("n") <= per_language)
    chosen = ids.groupBy("doc_id", "lang").agg(F.min("n").alias("n"))
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(presence(t or "")).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()), batch.column("lang"), batch.column("n")], ["seen", "lang", "n"])

    found = texts.select("text", "lang", "n").mapInArrow(measure, "seen binary, lang string, n int").toArrow().to_pylist()
    found.sort(key=lambda row: (row["lang"], row["n"], row["seen"]))
    bits = np.frombuffer(b"".join(row["seen"] for row in found), np.uint8).reshape(-1, DIMENSIONS // 8)
    return fit(np.unpackbits(bits, axis=1).astype(bool), [row["lang"] for row in found])


def identified(docs: DataFrame, model: KernelModel) -> DataFrame:
    """doc_id, lang_pred and score of every document."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(1).to_pylist()
                worded = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts])
                seen = np.stack([presence(t) if w else np.zeros(DIMENSIONS, bool) for t, w in zip(texts, worded, strict=True)])
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if model.languages:
                    margins = model.margins(seen)
                    best = margins.argmax(1)
                    scores = np.where(worded, np.clip((margins.max(1) + 1) / 2, 0, 1), 0.0)
                    names = [model.languages[k] if w else UNKNOWN for k, w in zip(best, worded, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def op7_kernel_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = identified(docs, train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
