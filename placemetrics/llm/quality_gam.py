"""Quality classifier: an additive model of lookup tables with pairwise interactions.

Each feature has a table of log-odds per bin, learned by cyclic boosting: in every round
each feature in turn gets one shallow tree on the current residuals, at a small rate.
Then the pairs of features that explain most of the rest get tables over two features the
same way.  A score is the sum of one table entry per feature and pair.

The model is fitted on at most ``MAX_LABELLED`` labelled rows, taken in the order of a hash
of their id; everything else covers all rows and whole texts.  Null and empty texts have
zeros as features and get a score like any text.  Without labels of both kinds every
score is the share of label 1, or 0.5.  A document with several labels counts with each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.llm.common import documents, in_slices, remainder, shingle_hashes, text_bytes, word_edges, word_hashes

#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 20_000
BINS = 24
ROUNDS = 150
PAIRS = 4
PAIR_BINS = 8
PAIR_ROUNDS = 40
RATE = 0.15
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "symbols", "bars", "exclamations", "capitals", "digits", "stops", "other_ascii",
    "word_bytes", "line_bytes", "distinct_words", "commonest_word", "same_as_previous", "distinct_runs", "distinct_lines",
)
_CLASSES = {"symbols": b"#*$%&<>@^~=+_\\{}[]", "bars": b"|", "exclamations": b"!?", "digits": b"0123456789",
            "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "stops": b".,;:", "other_ascii": b"\"'()-/`"}


def features(data: bytes) -> list[float]:
    """Feature values of a whole text, each bounded or a logarithm."""
    out = dict.fromkeys(FEATURES, 0.0)
    _, starts, ends = word_edges(data)
    n = len(starts)
    if n:
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        inside = int((ends - starts).sum())
        for name, members in _CLASSES.items():
            out[name] = float(counts[list(members)].sum()) / inside
        words = word_hashes(data)
        _, times = np.unique(words, return_counts=True)
        lines = data.split(b"\n")
        runs = shingle_hashes(words, 3)
        out |= {
            "log_bytes": float(np.log1p(len(data))), "word_bytes": float(np.log1p(inside / n)),
            "line_bytes": float(np.log1p(len(data) / len(lines))), "distinct_words": len(times) / n,
            "commonest_word": float(times.max()) / n, "same_as_previous": float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0,
            "distinct_runs": len(np.unique(runs)) / len(runs), "distinct_lines": len(set(lines)) / len(lines),
        }
    return [out[name] for name in FEATURES]


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature, tables over pairs of features, and a constant."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values per bin of the tree that splits each run of bins where the gain is largest."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        at = int(gains.argmax()) + 1
        if gains[at - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.r_[_shallow_tree(g[:at], h[:at], depth - 1), _shallow_tree(g[at:], h[at:], depth - 1)]
    return np.full(len(g), g.sum() / (h.sum() + 1.0))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The tree with one cut on either feature: its gain and its leaf values per cell."""
    sums = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h)]
    best, cut = -1.0, (1, 1)

    def corners(s: np.ndarray, i: int, j: int) -> list[float]:
        return [s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j]]

    for i in range(1, max(2, g.shape[0])):
        for j in range(1, max(2, g.shape[1])):
            gain = sum(float(_gain(a, b)) for a, b in zip(corners(sums[0], i, j), corners(sums[1], i, j), strict=True))
            if gain > best:
                best, cut = gain, (i, j)
    values = [a / (b + 1.0) for a, b in zip(corners(sums[0], *cut), corners(sums[1], *cut), strict=True)]
    table = np.empty(g.shape)
    i, j = cut
    table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = values
    return best - float(_gain(g.sum(), h.sum())), table


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on the rows of ``x`` with labels 0 and 1."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    k = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(k)]
    binned = [np.searchsorted(model.edges[j], x[:, j], "right") for j in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = residuals()
            n = len(model.tables[j])
            step = RATE * _shallow_tree(np.bincount(binned[j], g, n), np.bincount(binned[j], h, n), 2)
            model.tables[j] += step
            total += step[binned[j]]
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    cells = [np.searchsorted(model.coarse[j], x[:, j], "right") for j in range(k)]

    def histograms(a: int, b: int) -> list[np.ndarray]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return [np.bincount(cells[a] * shape[1] + cells[b], v, shape[0] * shape[1]).reshape(shape) for v in residuals()]

    ranked = sorted(((_quadrants(*histograms(a, b))[0], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)
    chosen = [(a, b) for _, a, b in ranked[:PAIRS]]
    tables = {pair: np.zeros([len(model.coarse[j]) + 1 for j in pair]) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            step = RATE * _quadrants(*histograms(a, b))[1]
            tables[a, b] += step
            total += step[cells[a], cells[b]]
    model.pairs = [(a, b, tables[a, b]) for a, b in chosen]
    return model


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t or b"") for t in texts], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_LABELLED) -> AdditiveModel:
    """Fit on the labelled rows of ``docs`` that are not held out, ``rows`` at most."""
    usable = labels.select("doc_id", F.col("quality").alias("label")).filter("label in (0, 1)").filter(remainder("doc_id", 5) != 0)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select("doc_id", text_bytes().alias("body")).join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            matrix = _matrix(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(matrix.tolist(), pa.list_(pa.float64())), batch.column("label").cast(pa.int32())], ["x", "label"])

    found = texts.select("body", "label").mapInArrow(measure, "x array<double>, label int").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = found.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T))  # rows arrive in any order; sums must not depend on it
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``docs`` with ``score``, the model's probability of label 1 (a column of that name is replaced)."""
    docs = docs.drop("score")
    text_at, names = docs.columns.index("text"), docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            found = model.scores(_matrix(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def op1_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    model = train(docs, read_labels(spark, folder))
    return scored(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
