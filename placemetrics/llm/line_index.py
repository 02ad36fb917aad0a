"""Line dedup through a sharded minimal perfect hash over all distinct lines.

1. Each bucket of documents gives its distinct line hashes and in how many of its
   documents each occurs (``bucket_lines``).
2. The distinct hashes are dealt to shards of bounded size.  Each shard becomes a
   minimal perfect hash with two arrays, a fingerprint and a document count per line.
3. The buckets' line hashes probe the shards' arrays; a line in thousands of documents
   is probed once for each bucket, not once for each document.
4. Each bucket reads its lines to drop, then streams its documents.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased.  A null text is one empty line and comes back as the empty text.  Empty keys
stay (``min_chars``).  Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.llm.common import WHOLE, documents, in_slices, mix, parts, stored

#: Distinct lines per shard, about: some 2 MB of arrays.
SHARD_LINES = 200_000
#: Bits of a level for each key placed there.
LOOSENESS = 2
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def code_points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def as_pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def as_digests(high: np.ndarray, low: np.ndarray) -> list[bytes]:
    flat = np.stack([high, low], 1).astype(">i8").tobytes()
    return [flat[k : k + 16] for k in range(0, len(flat), 16)]


class PerfectHash:
    """Minimal perfect hash: levels of bits, a key counts where no other key shares its bit.

    Levels place a key by 64 bits made of its 128.  Keys that agree in those 64 share their bit
    on every level, so they are left after MAX_LEVELS, with a handful of unlucky ones; these are
    told apart by all 128 bits, so every key has a place of its own.
    """

    MAX_LEVELS = 40

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        rest, offset = self.join(high, low), 0
        self.n, left = len(rest), np.arange(len(rest))
        while len(rest) and len(self.levels) < self.MAX_LEVELS:
            size = LOOSENESS * len(rest) + 1
            at = self.slot(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little")
            before = np.r_[0, np.cumsum(np.unpackbits(words, bitorder="little").reshape(-1, 8).sum(1, dtype=np.int64))[:-1]]
            self.levels.append((size, words, before, offset))
            offset += int(alone.sum())
            rest, left = rest[~alone[at]], left[~alone[at]]
        whole = zip(high[left].tolist(), low[left].tolist(), strict=True)
        self.rest = {key: offset + k for k, key in enumerate(sorted(whole))}

    @staticmethod
    def join(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return mix(high.view(np.uint64)) ^ (mix(low.view(np.uint64) + np.uint64(1)) << np.uint64(1))

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B9 + 7)) % np.uint64(size)).astype(np.int64)

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place, 0 to n - 1, of each key (some place or -1 for keys never put in)."""
        keys = self.join(high, low)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words, before, offset) in enumerate(self.levels):
            at = self.slot(keys[left], level, size)
            byte, shift = words[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> shift) & 1 == 1
            below = np.bitwise_count(byte & ((1 << shift.astype(np.int64)) - 1).astype(np.uint8)).astype(np.int64)
            out[left[hit]] = offset + before[at[hit] >> 3] + below[hit]
            left = left[~hit]
        if len(left) and self.rest:
            out[left] = [self.rest.get(key, -1) for key in zip(high[left].tolist(), low[left].tolist(), strict=True)]
        return out


class Shard:
    """A perfect hash with its fingerprint and count arrays."""

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> None:
        self.hash = PerfectHash(high, low)
        at = self.hash.places(high, low)
        self.fingerprints = np.zeros(len(high), np.uint32)
        self.counts = np.zeros(len(high), np.uint32)
        self.fingerprints[at] = self.fingerprint(low)
        self.counts[at] = np.minimum(counts, 0xFFFFFFFF)

    @staticmethod
    def fingerprint(low: np.ndarray) -> np.ndarray:
        return (low.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def lookup(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Document counts of the keys; 0 for a key with another fingerprint."""
        if not len(self.counts):
            return np.zeros(len(high), np.uint32)
        at = self.hash.places(high, low)
        known = (at >= 0) & (self.fingerprints[at] == self.fingerprint(low))
        return np.where(known, self.counts[at], 0)


def bucket_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(bucket, high, low, n): distinct line keys of each bucket, and its documents with them."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, WHOLE):
            seen: Counter = Counter()
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = {line_key(line) for line in (data or b"").split(b"\n")}
                seen.update((bucket, digest(k)) for k in keys if k and (min_chars <= 1 or code_points(k) >= min_chars))
            pairs = as_pairs([d for _, d in seen])
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in seen], pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                 pa.array(list(seen.values()), pa.int64())], ["bucket", "high", "low", "n"])

    rows = docs.select("bucket", F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(lines, "bucket int, high bigint, low bigint, n bigint")
    return found.groupBy("bucket", "high", "low").agg(F.sum("n").alias("n"))


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(bucket, high, low) of the bucket's lines found in ``min_docs`` documents or more."""
    shards = lines.count() // SHARD_LINES + 1

    def probe(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(index["high"].to_numpy(), index["low"].to_numpy(), index["n"].to_numpy())
        counts = shard.lookup(asked["asked_high"].to_numpy(), asked["asked_low"].to_numpy())
        found = asked.loc[counts >= min_docs, ["bucket", "asked_high", "asked_low"]]
        return found.set_axis(["bucket", "high", "low"], axis=1)

    shard = F.pmod(F.xxhash64("high"), F.lit(shards)).cast("int").alias("shard")
    distinct = lines.groupBy("high", "low").agg(F.sum("n").alias("n")).select(shard, "high", "low", "n")
    asked = lines.select(shard.alias("asked_shard"), "bucket", F.col("high").alias("asked_high"), F.col("low").alias("asked_low"))
    return distinct.groupBy("shard").cogroup(asked.groupBy("asked_shard")).applyInPandas(
        probe, "bucket int, high bigint, low bigint")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` without lines found in ``min_docs`` documents or more, plus n_lines and n_dropped.

    n_lines counts before dropping.  A column of the input named like these two is replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    n = parts(docs.sparkSession)
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("bucket")
    dealt = docs.select(bucket, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lines = stored(bucket_lines(dealt.select("bucket", F.col("row.text").alias("text")), min_chars), "lines")
    drops = common_lines(lines, min_docs)
    both = dealt.withColumn("is_row", F.lit(True)).unionByName(drops.withColumn("is_row", F.lit(False)), allowMissingColumns=True)
    ordered = both.repartition(n, "bucket").sortWithinPartitions("bucket", "is_row")
    names = docs.columns
    text_at = names.index("text")

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, dropped = None, set()
        for batch in in_slices(batches, WHOLE):
            buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
            is_row = batch.column("is_row").to_numpy(zero_copy_only=False).astype(bool)
            high, low = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("high", "low"))
            rows = batch.column("row")
            texts = rows.field(text_at).cast(pa.binary()).to_pylist()
            kept, n_lines, n_dropped = [], [], []
            edges = np.flatnonzero(np.r_[True, np.diff(buckets) != 0]).tolist() + [len(buckets)]
            for a, b in zip(edges, edges[1:], strict=False):
                if buckets[a] != current:
                    current, dropped = buckets[a], set()
                ends = a + int((~is_row[a:b]).sum())  # lines to drop stand first
                dropped.update(as_digests(high[a:ends], low[a:ends]))
                for k in range(ends, b):
                    all_lines = (texts[k] or b"").split(b"\n")
                    left = [x for x in all_lines if digest(line_key(x)) not in dropped] if dropped else all_lines
                    kept.append(b"\n".join(left))
                    n_lines.append(len(all_lines))
                    n_dropped.append(len(all_lines) - len(left))
            chosen = rows.filter(pa.array(is_row))
            columns = [chosen.field(k) for k in range(len(names))]
            columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return ordered.mapInArrow(without, schema)


def op6_line_index(spark, folder: str) -> DataFrame:
    kept = dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT r, doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (c.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r, doc_id
"""
