"""Removal of repeated passages: every byte covered by a WINDOW-byte string that starts twice.

Sorting all suffixes of a corpus would move many times its size.  So windows are first dealt
by content, losing none:

1. The anchor of a window is the place in it whose GRAM bytes hash lowest; equal windows have
   equal anchors.  The windows of one anchor form an interval of starts, their union a block.
   Blocks whose anchor gram occurs once in the corpus hold no repeated window.
2. A block that occurs twice in full has all its windows repeated.
3. A gram with more than CROWDED different blocks is dealt again by more of the windows'
   content.  Windows of one gram that start 0 to 368 bytes before it are halved by that
   distance, again and again: all windows of a half have the bytes between its ends in common,
   those name the new group.  A part that stands alone in its group has no repeated window,
   one that occurs twice in full has nothing else; at most the parts around an edge go on, so
   rows stay in proportion to blocks.
4. What is left, one copy of each block whose group has others, goes with its text to shards by
   group.  A shard is sorted by external induced sorting (``induced_sort``); neighbours with
   WINDOW bytes in common are repeated windows.

Texts are UTF-8 bytes, null is empty; matches never cross documents; the same passage twice in
one document counts.  Rows that repeat an id, or are equal, are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.llm.common import _POWERS, documents, in_slices, mix, stored, text_bytes
from placemetrics.llm.induced_sort import Workspace, suffix_order

WINDOW, GRAM = 400, 32
#: Bytes of text of one shard, about; memory of its queues and arrays before they go to disk;
#: symbols of a string of names that are ordered in memory.
SHARD_BYTES, SORT_MEMORY, IN_MEMORY = 1 << 20, 64 << 20, 4 << 20
#: Different blocks of one group, about 2 MB of text, beyond which it is dealt again.
CROWDED = 4096
#: Window starts looked at together.
BLOCK = 1 << 20


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks(data: bytes, window: int = WINDOW, gram: int = GRAM) -> list[tuple[np.ndarray, ...]]:
    """Per anchor: gram hash, first and last window start, and where the anchor is."""
    found = []
    for base in range(0, len(data) - window + 1, BLOCK):
        codes = np.frombuffer(data, np.uint8)[base : base + BLOCK + window - 1]
        n = len(codes)
        up, down = _POWERS.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        low = np.uint64((1 << 22) - 1)
        least = _sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        anchor = (least & low).astype(np.int64)  # for each window start
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.r_[first[1:], len(anchor)] - 1
        at = anchor[first]
        found.append((grams[at].view(np.int64), first + base, last + base, at + base))
    return found


def named(part: bytes, *shape: int) -> bytes:
    """128 bits that tell a piece of text from others, with numbers that belong to it."""
    return xxhash.xxh3_128_digest(part + b"".join(n.to_bytes(4, "little") for n in shape))


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, gram, block, first, last): the blocks of every document; ``docs`` has row and body."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            owner, grams, names, firsts, lasts = [], [], [], [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                for gram, first, last, at in blocks(data):
                    owner.append(np.full(len(gram), k))
                    grams.append(gram)
                    firsts.append(first)
                    lasts.append(last)
                    names += [named(data[a : b + WINDOW], c - a, b - a) for a, b, c in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)]
            if not owner:
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(grams)), pa.array(names, pa.binary()),
                 pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(lasts).astype(np.int32))],
                ["row", "gram", "block", "first", "last"])

    return docs.mapInArrow(cut, "row binary, gram bigint, block binary, first int, last int")


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, row, first, last, crowded, body): the text of the wanted blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            lists = batch.column("wanted")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            first, last = (flat.field(k).to_numpy() for k in (1, 2))
            texts = batch.column("body").to_pylist()
            body = [texts[k][a : b + WINDOW] for k, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True)]
            rows = batch.column("row").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [flat.field(0), rows, flat.field(1), flat.field(2), flat.field(3), pa.array(body, pa.binary())],
                ["gram", "row", "first", "last", "crowded", "body"])

    listed = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "first", "last", "crowded")).alias("wanted"))
    return docs.join(listed, "row").select("row", "body", "wanted").mapInArrow(
        cut, "gram bigint, row binary, first int, last int, crowded boolean, body binary")


_PART = "name binary, part binary, row binary, first int, last int, near int, far int, at int, body binary"


def _halved(parts_of: DataFrame) -> DataFrame:
    """The two halves of every part: windows that start ``near`` to ``far`` bytes before the anchor.

    ``name`` is a hash of what all windows of the half have in common, ``part`` one of all its
    text; first, last and body are its own, ``at`` is the anchor's place in the body.  Parts
    with ``near`` null are blocks, whose anchor is found again.
    """
    whole = WINDOW - GRAM

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out: list[tuple] = []
            for row, first, near, far, at, body in zip(*(batch.column(c).to_pylist() for c in ("row", "first", "near", "far", "at", "body")), strict=True):
                if near is None:
                    near, far, at = 0, whole, int(blocks(body)[0][3][0])
                middle = (near + far) // 2
                for low, high in ((near, middle), (middle + 1, far)):
                    # windows of the half that this block has, by their distance to the anchor
                    a, b = max(low, at + WINDOW - len(body)), min(high, at)
                    if a > b or low > high:
                        continue
                    name = named(body[at - low : at + WINDOW - high], low, high)
                    text = body[at - b : at + WINDOW - a]
                    start = first + at - b
                    out.append((name, named(text, b, b - a), row, start, start + b - a, low, high, b, text))
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k in (3, 4, 5, 6, 7) else pa.binary()) for k, c in enumerate(columns)],
                ["name", "part", "row", "first", "last", "near", "far", "at", "body"])

    return parts_of.select("row", "first", "near", "far", "at", "body").mapInArrow(halve, _PART)


def _dealt_again(crowded: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Repeated intervals (row, first, last), and parts (name, row, first, last, body) still to be sorted.

    At most nine rounds; each halves the distances.
    """
    settled, undecided = [], []
    now = crowded.selectExpr("row", "first", "cast(null as int) as near", "cast(null as int) as far", "cast(null as int) as at", "body")
    while True:
        halves = stored(_halved(now), "halves")
        fields = ("row", "first", "last", "near", "far", "at", "body")
        kinds = stored(halves.groupBy("name", "part").agg(F.count("*").alias("n"), F.min(F.struct(*fields)).alias("one")), "parts")
        settled.append(halves.select("name", "part", "row", "first", "last").join(
            kinds.filter("n > 1").select("name", "part"), ["name", "part"]).select("row", "first", "last"))
        groups = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
        left = stored(kinds.join(groups.select("name", "kinds"), "name").select("name", "kinds", "one.*"), "left")
        undecided.append(left.filter(F.col("kinds") <= CROWDED).select("name", "row", "first", "last", "body"))
        now = left.filter(F.col("kinds") > CROWDED).select("row", "first", "near", "far", "at", "body")
        if now.isEmpty():
            return settled, undecided


def repeated_windows(frame: pd.DataFrame, memory: int = SORT_MEMORY, in_memory: int = IN_MEMORY, window: int = WINDOW) -> pd.DataFrame:
    """Intervals (row, first, last) of the windows of the blocks in ``frame`` that are repeated in it."""
    frame = frame.sort_values(["row", "first", "last"], kind="stable").reset_index(drop=True)
    sizes = frame["body"].str.len().to_numpy()
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    for at, body in zip(starts.tolist(), frame["body"], strict=True):
        text[at : at + len(body)] = np.frombuffer(body, np.uint8).astype(np.uint16) + 1
    owner = np.full(len(text), -1, np.int32)  # the block whose window starts here
    for k, (at, a, b) in enumerate(zip(starts.tolist(), frame["first"].tolist(), frame["last"].tolist(), strict=True)):
        owner[at : at + b - a + 1] = k
    with Workspace(memory) as space:
        order, common = suffix_order(text, space, in_memory, window)
        chosen = np.flatnonzero(owner[order] >= 0)
        if not len(chosen):
            return pd.DataFrame({"row": pd.Series(dtype="object"), "first": pd.Series(dtype="int32"), "last": pd.Series(dtype="int32")})
        shared = np.minimum.reduceat(common, np.r_[0, chosen[:-1] + 1])
        begins = np.r_[True, shared[1:] < window]
        places = np.array(order[chosen])
    group = np.cumsum(begins) - 1
    hit = np.sort(places[np.bincount(group)[group] > 1])
    cuts = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)]) if len(hit) else np.zeros(0, np.int64)
    a, b = hit[cuts], hit[np.r_[cuts[1:], len(hit)] - 1] if len(hit) else hit
    k = owner[a]
    shift = frame["first"].to_numpy()[k] - starts[k]
    return pd.DataFrame({"row": frame["row"].to_numpy()[k], "first": (a + shift).astype(np.int32), "last": (b + shift).astype(np.int32)})


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(row, first, last): intervals of window starts whose window starts elsewhere too."""
    found = stored(occurrences(docs), "blocks")
    # written, so that the join below reads two shuffles and Spark can split a gram with many rows
    grams = stored(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    candidates = stored(found.join(grams, "gram"), "repeated")
    kinds = candidates.groupBy("gram", "block").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("one"))
    kinds = stored(kinds, "kinds")
    whole = candidates.join(kinds.filter("n > 1").select("gram", "block"), ["gram", "block"]).select("row", "first", "last")
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    wanted = kinds.join(mixed, "gram").select("gram", "one.*", (F.col("kinds") > CROWDED).alias("crowded"))
    texts = stored(_with_text(docs, wanted), "undecided")
    found_so_far, to_sort = [whole], [texts.filter("not crowded").select(F.col("gram").cast("string").cast("binary").alias("name"), "row", "first", "last", "body")]
    crowded = texts.filter("crowded")
    if not crowded.isEmpty():
        settled, undecided = _dealt_again(crowded)
        found_so_far += settled
        to_sort += undecided
    everything = reduce(DataFrame.union, to_sort)
    total = everything.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = total // SHARD_BYTES + 1

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        return repeated_windows(frame)

    dealt = everything.select("row", "first", "last", "body", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"))
    result = dealt.groupBy("shard").applyInPandas(sort, "row binary, first int, last int")
    return reduce(DataFrame.union, [*found_so_far, result])


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals, half open, that the windows with these starts cover."""
    order = np.argsort(first, kind="stable")
    a, b = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + WINDOW)
    new = np.r_[True, a[1:] > b[:-1]] if len(a) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return a[starts], b[np.r_[starts[1:], len(a)] - 1] if len(a) else b


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans and spans (start, end) of every document."""
    docs = docs.select("doc_id", text_bytes().alias("body"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), F.lit(b":"), "body")
    row = F.unhex(F.md5(name)).alias("row")
    intervals = repeated_starts(docs.select(row, "body")).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            kept, removed, spans = [], [], []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = found.values
                if values is None or not len(values):
                    kept.append(data)
                    removed.append(0)
                    spans.append([])
                    continue
                a, b = merged(values.field(0).to_numpy(), values.field(1).to_numpy())
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(int((b - a).sum()))
                spans.append(np.stack([a, b], 1).tolist())
            sizes = [len(k) + r for k, r in zip(kept, removed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "body", row).join(intervals, "row", "left").select("doc_id", "body", "found")
    return joined.mapInArrow(
        cut, f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<array<bigint>>, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(documents(spark, folder)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
