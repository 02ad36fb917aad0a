"""Helpers shared by the text operators: inputs, stored tables, hashed words."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)
#: Longest stretch of text hashed at once, in bytes.
BLOCK = 1 << 20
#: Bytes from which on a word is hashed by itself: sums of powers modulo 2^64 have equal values
#: for some long words of two letters.
LONG_WORD = 128
#: Rows of a slice of an Arrow batch; WHOLE leaves batches as they are.
SLICE, WHOLE = 512, 1 << 30


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it.

    Nothing changes where PYTHONPATH names that folder already: workers started with
    another environment are others, and both kinds would stay in memory.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = f"{os.environ.get('PYTHONPATH', '')}{os.pathsep}{env.get('PYTHONPATH', '')}".split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one uses its warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: cuts lineage, survives executors."""
    importable(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a worker copies out few texts at a time.

    After the last one the worker gives memory back: it lives on for other tasks, beside its JVM.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Memory that this process no longer uses goes to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table the driver holds, handed over as Arrow: no other kind of Python worker reads it."""
    return spark.createDataFrame(pa.table(columns))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, kept for blocks of text."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE_INVERSE, np.uint64)])
        return self.up, self.down


_POWERS = _Powers()


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and the starts and ends of the words in them."""
    codes = np.frombuffer(data.translate(_FOLD), np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    np.not_equal(codes, 32, out=inside[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(inside))
    return codes, edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return edged_hashes(*word_edges(data))


def edged_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``word_hashes`` where the words' edges are known."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        # whole words, about BLOCK bytes (a longer word makes a longer block)
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + BLOCK, "right")))
        first, last = int(starts[k]), int(ends[stop - 1])
        up, down = _POWERS.upto(last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((codes[first:last].astype(np.uint64) + np.uint64(1)) * up[: last - first], out=sums[1:])
        a, b = starts[k:stop] - first, ends[k:stop] - first
        out[k:stop] = (sums[b] - sums[a]) * down[a]
        k = stop
    for k in np.flatnonzero(ends - starts >= LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(codes[starts[k]:ends[k]].tobytes())
    return mix(out)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of the whole sequence where there are fewer."""
    n = min(size, len(words))
    if n == 0:
        return words
    total = np.full(len(words) - n + 1, np.uint64(n * 0xA0761D6478BD642F & _MASK))
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _PLACES[k]
    return mix(total)


def shingle_set(data: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(data), size))
