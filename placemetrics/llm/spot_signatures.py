"""Document fingerprints from spot signatures.

The corpus's own common words, the COMMON with the highest document frequency over all rows
(punctuation around words left aside), are no content; ANCHORS of them, the most frequent, start
a chain: the signature is the next CHAIN content words behind it.  The start of a line does too.  A
text with fewer such words than one in SPARSE, as in a language the corpus has little of, also
takes every word as an anchor whose hash is 0 modulo EVERY, so that signatures grow with any text.
The fingerprint of a text is the sorted
set of its signatures as hex, eight digits each.  Likeness is the Jaccard coefficient of two
such sets, given up as soon as the set lengths, or what is left of them, rule out the least
likeness asked for.

A null or empty text has no words and the empty fingerprint; two empty fingerprints have
likeness 1.  Where a text ends before the chain does, the chain is what is there.  Fingerprints
are comparable where the common words are the same: they are a table of COMMON hashes at most.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from placemetrics.llm.common import _PLACES, documents, edged_hashes, in_slices, mix, parts, small_table, stored, text_bytes, word_edges, word_hashes

#: Words with the highest document frequency that are no content, and those that start a chain.
COMMON, ANCHORS = 256, 64
CHAIN = 2
#: A text with fewer anchors than one word in SPARSE takes one of EVERY different words, by hash, too.
SPARSE, EVERY = 16, 8
#: Words counted together by one task before they are added up.
COUNTED = 1 << 20
_PUNCTUATION = string.punctuation.encode()
_MARK = np.isin(np.arange(256), np.frombuffer(_PUNCTUATION, np.uint8))


_LINE = np.uint64(0x5851F42D4C957F2D)


def _among(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    if not len(members):
        return np.zeros(len(values), bool)
    return members[np.minimum(np.searchsorted(members, values), len(members) - 1)] == values


def _bare(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of the words without ASCII punctuation around them."""
    bare = words.copy()
    marked = np.flatnonzero(_MARK[codes[starts]] | _MARK[codes[stops - 1]])
    if len(marked):
        raw = codes.tobytes()
        stripped = [raw[starts[k] : stops[k]].strip(_PUNCTUATION) for k in marked]
        full = np.array([bool(w) for w in stripped])
        bare[marked[full]] = word_hashes(b" ".join(w for w in stripped if w))
    return bare


def common_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the COMMON words that most rows of ``docs`` have, the most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in in_slices(batches):
            for data in batch.column(0).to_pylist():
                edges = word_edges(data)
                if len(edges[1]):
                    held.append(np.unique(_bare(*edges, edged_hashes(*edges))))
                    size += len(held[-1])
            if size > COUNTED:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counted = docs.select(text_bytes().alias("body")).mapInArrow(count, "word bigint, n bigint")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON).collect()
    return np.array([r["word"] for r in top], np.int64).view(np.uint64)


@cache
def _in_order(common: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The common words' hashes and those of the anchors among them, sorted."""
    hashes = np.frombuffer(common, np.uint64)
    return np.sort(hashes), np.sort(hashes[:ANCHORS])


def fingerprint(text: str, common: np.ndarray) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a whole text, given the ``common_words``."""
    data = text.encode("utf-8", "replace")
    codes, starts, stops = word_edges(data)
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint32)
    words = edged_hashes(codes, starts, stops)
    no_content, opening = _in_order(common.tobytes())
    bare = _bare(codes, starts, stops, words)
    content = np.flatnonzero(~_among(bare, no_content))
    if not len(content):
        content = np.arange(n)
    chosen = _among(bare, opening)
    if chosen.sum() * SPARSE < n:
        chosen |= bare % np.uint64(EVERY) == 0
    anchors = np.flatnonzero(chosen)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    first = np.unique(np.r_[0, np.searchsorted(starts, breaks)])
    first = first[first < n]
    total = np.r_[words[anchors], np.full(len(first), _LINE)] * _PLACES[0]
    at = np.r_[np.searchsorted(content, anchors, "right"), np.searchsorted(content, first, "left")]
    padded = np.r_[words[content], np.zeros(CHAIN, np.uint64)]
    for k in range(CHAIN):
        total += padded[np.minimum(at + k, len(content))] * _PLACES[k + 1]
    return np.unique((mix(total) >> np.uint64(32)).astype(np.uint32))


def as_text(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient of two sorted sets; 0 where it is below ``least``."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small < least * large:  # the lengths alone rule it out
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    found = common / (small + large - common)
    return found if found >= least else 0.0


def length_class(size: int, least: float) -> int:
    """Sets whose classes differ by two or more cannot reach ``least``."""
    return 0 if size == 0 else 1 + int(np.log(size) / -np.log(least))


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, borrowed, tie, doc_id, text): rows by descending doc_id in buckets of ids.

    Each bucket ends with borrowed rows: the first of the next bucket (after the last: of
    the first), so every row meets its successor in its own partition.  Ids are cut into
    buckets by quantiles, which only deal the rows: they are ordered as what they are.  The
    buckets' first ids go through the driver.  Null ids
    come last; rows with equal ids follow a hash of their text.
    """
    n = parts(docs.sparkSession)
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("id")
    ids = docs.select(number, "doc_id", F.xxhash64("text").alias("tie"))
    cuts = ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    splits = sorted({c for c in cuts or [] if np.isfinite(c)})
    rows = docs.select(number, F.xxhash64("text").alias("tie"), "doc_id", "text")
    if splits:
        deal = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="id", outputCol="at").transform
    else:  # one bucket: too few different ids
        deal = lambda df: df.withColumn("at", F.lit(0.0))
    tops = {int(r["at"]): r["top"] for r in deal(ids).groupBy("at").agg(F.max(F.struct("doc_id", "tie")).alias("top")).collect()}
    order = sorted(tops, reverse=True)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    lent = small_table(docs.sparkSession, lent_id=pa.array([tops[b]["doc_id"] for b in order], kind),
                       lent_tie=pa.array([tops[b]["tie"] for b in order], pa.int64()),
                       to=pa.array([order[k - 1] for k in range(len(order))], pa.int32()))
    copies = F.explode(F.array_compact(F.array(
        F.struct(F.col("at").cast("int").alias("bucket"), F.lit(False).alias("borrowed")),
        F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("borrowed"))))))
    first = F.col("doc_id").eqNullSafe(F.col("lent_id")) & (F.col("tie") == F.col("lent_tie"))
    dealt = deal(rows).join(F.broadcast(lent), first, "left").select(copies.alias("c"), "tie", "doc_id", "text")  # a row a bucket
    flat = dealt.select("c.bucket", "c.borrowed", "tie", "doc_id", "text")
    return flat.repartition(n, "bucket").sortWithinPartitions("bucket", "borrowed", F.desc_nulls_last("doc_id"), F.desc("tie"), F.desc("text"))


RESULT = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_signatures int")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next.

    ``common`` are the ``common_words`` of another corpus, if its fingerprints are to be met.
    """
    common = common_words(docs) if common is None else common

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None  # (bucket, doc_id, text, signatures), waiting for its successor
        for batch in in_slices(batches):
            for bucket, borrowed, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if borrowed and (held is None or held[0] != bucket):
                    continue  # the bucket's last row has met its successor
                text = text or ""
                now = (bucket, doc_id, text, fingerprint(text, common))
                if held is not None and held[0] == bucket:
                    yield held, now
                held = None if borrowed else now

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for (_, doc_id, text, own), (_, _, following, other) in pairs(batches):
            new = edited(text, following)
            changed = fingerprint(new, common)
            out.append((doc_id, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), as_text(own), as_text(changed),
                        likeness(own, changed), likeness(own, other), len(own)))
            chars += 8 * (len(own) + len(changed)) + 200
            if chars > 1 << 22:
                yield flush()
                out, chars = [], 0
        if out:
            yield flush()

    kind = docs.schema["doc_id"].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
    names = ["doc_id", *(part.strip().split()[0] for part in RESULT.split(","))]
    return in_order(docs.select("doc_id", "text")).mapInArrow(compare, f"doc_id {kind.simpleString()}, {RESULT}")


def near_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints with ``least`` likeness or more.

    ``prints`` has (doc_id, fingerprint); equal fingerprints stand for one class, named by
    its smallest doc_id.  Sets are dealt by length class and by the rarest signatures, as
    many as a pair of that likeness must share one of.
    """
    classes = prints.filter("fingerprint <> ''").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    size = (F.length("fingerprint") / 8).cast("int")
    one = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.substr(F.col("fingerprint"), 8 * k + 1, F.lit(8)))
    sets = stored(classes.select("doc_id", "fingerprint", size.alias("size"), one.alias("signatures")), "spots")
    each = sets.select("doc_id", "size", F.explode("signatures").alias("signature"))
    rarity = each.groupBy("signature").agg(F.count("*").alias("n"))
    ranked = each.join(rarity, "signature").groupBy("doc_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "signature"))).alias("s"))
    prefix = ranked.select("doc_id", "size", F.explode(F.slice("s", 1, F.col("size") - F.ceil(F.col("size") * least).cast("int") + 1)).alias("s"))
    level = (F.floor(F.log("size") / -np.log(least))).cast("int")
    posting = prefix.filter("s.n > 1").select("doc_id", "size", level.alias("level"), "s.signature")
    other = posting.select(F.col("doc_id").alias("b"), F.col("size").alias("b_size"), "signature",
                           F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1)).alias("level"))
    met = posting.join(other, ["level", "signature"]).filter(
        (F.col("doc_id") < F.col("b")) & (F.least("size", "b_size") >= least * F.greatest("size", "b_size")))
    pairs = met.select(F.col("doc_id").alias("a"), "b").distinct()
    left = sets.select(F.col("doc_id").alias("a"), F.col("signatures").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("signatures").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    alike = common / (F.size("x") + F.size("y") - common)
    return pairs.join(left, "a").join(right, "b").select("a", "b", alike.alias("likeness")).filter(F.col("likeness") >= least)


def op2_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return compared(documents(spark, folder))
