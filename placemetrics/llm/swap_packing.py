"""Packing documents into sequences: best fit, then a swap-based local search.

Documents become token ids and one closing id.  Longer ones than a sequence are cut into
pieces.  Pieces are dealt to groups of about GROUP_TOKENS tokens; a group is packed by best
fit, longest first, then bins that are not full exchange pieces: a move, one for one, or two
for one.  An exchange must raise the sum of squared fills, so bins fill up or empty out.  Bins
left underfull in all groups are dealt anew to fewer groups and packed again, until one group
holds them or they no longer get fewer.

A null or empty text is its closing id alone.  Rows that repeat an id are documents of
their own.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.llm.common import documents, stored
from placemetrics.operators.ordering import total_before

CAPACITY = 4096
CLOSING_ID = 1
#: Tokens of one packing group, about.
GROUP_TOKENS = 8_000_000
#: Tokens of one group where the order of the mix is kept, about; ranges that a group is cut from.
MIXED_TOKENS, RANGES = 1_000_000, 8
#: Bins less full than this are packed again with those of other groups.
SETTLED = 0.985
#: Emptiest bins that a bin tries to exchange with, in each pass.
DONORS = 32
#: Chunks whose ids a worker remembers, at most, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64
#: Characters whose words are held at once.
BLOCK = 1 << 20
#: Latin text without unusual spaces or combining marks: there every white space ends a word.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f]|<\\|")


class Tokens:
    """Ids of whole texts as little-endian 32-bit bytes, by the given tokenizer file.

    The tokenizer drops white space and never joins across it, so in plain Latin text each
    chunk between spaces has ids of its own, which are remembered.  Other texts, and those
    that may hold special tokens, go through the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.marks = dict(zip(".,", self.whole([".", ","]), strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The texts' ids, worked out for about BLOCK characters at a time."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _learned(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of new chunks; a word with a stop or comma behind it is its word's ids and the mark's."""
        marked = {c for c in missing if c[-1] in self.marks and c[:-1].isalpha()}
        new = list((missing - marked) | {c[:-1] for c in marked if c[:-1] not in self.known})
        learned = dict(zip(new, self.whole(new), strict=True))
        for c in marked:
            word = self.known.get(c[:-1])
            learned[c] = (learned[c[:-1]] if word is None else word) + self.marks[c[-1]]
        return learned

    def _block(self, texts: list[str]) -> list[bytes]:
        plain = [None if _UNUSUAL.search(t) else t.lower().split() for t in texts]
        get = self.known.get
        found = [None if chunks is None else list(map(get, chunks)) for chunks in plain]
        missing = {c for chunks, values in zip(plain, found, strict=True) if values is not None and None in values
                   for c, value in zip(chunks, values, strict=True) if value is None}
        learned = self._learned(missing)
        out = []
        for text, chunks, values in zip(texts, plain, found, strict=True):
            if values is None:
                out.append(self.whole([text])[0])
            elif None in values:
                out.append(b"".join([learned[c] if v is None else v for c, v in zip(chunks, values, strict=True)]))
            else:
                out.append(b"".join(values))
        if len(self.known) >= REMEMBERED and 5 * len(learned) > sum(len(v) for v in found if v):
            self.known.clear()  # other words than those remembered
        room = max(0, REMEMBERED - len(self.known))
        self.known.update([x for x in learned.items() if len(x[0]) <= REMEMBERED_CHARS][:room])
        return out


@cache
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False,
           carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids, little-endian, and carried columns if asked for)."""
    path = path or tokenizer_path()
    closing = np.array([CLOSING_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids + list(carried)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, ids in enumerate(tokens.ids([t or "" for t in batch.column(1).to_pylist()])):
                ids += closing
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    owner.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            owners = pa.array(owner, pa.int64())
            columns = [batch.column(0).take(owners), pa.array(piece, pa.int32()),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids
                                              + [batch.column(2 + k).take(owners) for k in range(len(carried))], names)

    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([id_field, T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in names[2:5]]
                          + [T.StructField("ids", T.BinaryType())] * keep_ids + [T.StructField(c, docs.schema[c].dataType) for c in carried])
    return docs.select("doc_id", "text", *carried).mapInArrow(cut, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = bisect_left(rooms, (lengths[item], -1))
        if at < len(rooms):
            room, place = rooms.pop(at)
            bins[place].append(item)
        else:
            room, place = capacity, len(bins)
            bins.append([item])
        if room > lengths[item]:
            insort(rooms, (room - lengths[item], place))
    return bins


def _exchange(lengths: list[int], into: list[int], out: list[int], room: int, least: int) -> tuple[list[int], list[int]] | None:
    """Items of ``out`` for items of ``into`` that add the most, above ``least`` and within ``room``."""
    best, choice = max(least, 0), None
    one = [((), 0)] + [((x,), lengths[x]) for x in into]
    two = [((y,), lengths[y]) for y in out] + [((y, z), lengths[y] + lengths[z]) for k, y in enumerate(out) for z in out[k + 1 :]]
    two.sort(key=lambda c: c[1])
    sizes = [c[1] for c in two]
    for given, size in one:
        at = bisect_left(sizes, size + room + 1) - 1
        if at >= 0 and sizes[at] - size > best:
            best, choice = sizes[at] - size, (list(two[at][0]), list(given))
    return choice


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull bins while the sum of squared fills rises."""
    fills = [sum(lengths[k] for k in b) for b in bins]
    fewest = -(-sum(fills) // capacity)
    improved = True
    while improved and sum(1 for f in fills if f) > fewest:
        improved = False
        order = sorted((k for k, f in enumerate(fills) if 0 < f < capacity), key=lambda k: -fills[k])
        donors = order[::-1][:DONORS]
        for b in order:
            for a in donors:
                room = capacity - fills[b]
                if a == b or not fills[a] or not fills[b] or room == 0:
                    continue
                # moving d tokens from a to b raises the sum of squares if fill(b) + d > fill(a)
                found = _exchange(lengths, bins[b], bins[a], room, fills[a] - fills[b])
                if found:
                    to_b, to_a = found
                    bins[b] = [k for k in bins[b] if k not in to_a] + to_b
                    bins[a] = [k for k in bins[a] if k not in to_b] + to_a
                    moved = sum(lengths[k] for k in to_b) - sum(lengths[k] for k in to_a)
                    fills[b] += moved
                    fills[a] -= moved
                    improved = True
    return [b for b in bins if b]


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def _in_ranges(rows: DataFrame, order: str, groups: int) -> DataFrame:
    """``rows`` with _group: ranges of ``order`` with about as many tokens each.

    The tokens of RANGES ranges a group, at least 4096, are added up one after the other by
    Spark; the driver sees the last value of ``order`` and the number of tokens.
    """
    n = max(4096, RANGES * groups)
    last, tokens = rows.agg(F.max(order), F.sum("length")).first()
    at = F.floor(F.col(order) * n / F.lit((last or 0) + 1)).cast("int")
    ranges = stored(rows.groupBy(at.alias("_at")).agg(F.sum("length").alias("tokens")), "ranges")
    group = F.floor(F.col("before") * groups / F.lit(max(tokens or 0, 1))).cast("int").alias("_group")
    return rows.withColumn("_at", at).join(total_before(ranges, "tokens", "before", ["_at"]).select("_at", group), "_at").drop("_at")


def _numbered_in(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with sequence_id 0, 1, ... by the mean ``order`` of a sequence's tokens."""
    mean = (F.sum(F.col(order) * F.col("length")) / F.sum("length")).alias("mean")
    each = stored(rows.groupBy("sequence_id").agg(mean), "sequences")
    n = max(1, each.count() // 10_000)
    last = (each.agg(F.max("mean")).first()[0] or 0) + 1
    each = each.withColumn("at", F.floor(F.col("mean") * n / F.lit(last)).cast("int"))
    before = Window.partitionBy().orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row per 10,000 sequences
    offsets = each.groupBy("at").agg(F.count("*").alias("n")).select("at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_"))
    inside = Window.partitionBy("at").orderBy("mean", "sequence_id")
    new = each.withColumn("k", F.row_number().over(inside)).join(offsets, "at")
    new = new.select("sequence_id", (F.col("offset_") + F.col("k") - 1).alias("_new"))
    return rows.join(new, "sequence_id").withColumn("sequence_id", F.col("_new")).drop("_new")


def packed(rows: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, order: str | None = None) -> DataFrame:
    """``rows`` (with length) plus sequence_id and offset, in few sequences of ``capacity`` tokens.

    With ``order``, a column of whole numbers, groups are ranges of it and sequences are
    numbered by it; the column is dropped.
    """
    rows = rows.drop("sequence_id", "offset")
    names = rows.columns
    extra = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_fill", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *extra])

    def pack(numbered: int):
        def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            order = [c for c in ("length", "doc_id", "piece", "ids_crc32") if c in frame]
            frame = frame.sort_values(order, kind="stable", ascending=[c != "length" for c in order]).reset_index(drop=True)
            lengths = frame["length"].astype(int).tolist()
            at, sequence, offset, fill = [], [], [], []
            for n, members in enumerate(pack_group(lengths, capacity)):
                place, total = 0, sum(lengths[k] for k in members)
                for k in members:
                    at.append(k)
                    sequence.append((numbered << 56) + (int(key[0]) << 24) + n)
                    offset.append(place)
                    fill.append(total)
                    place += lengths[k]
            return frame.iloc[at].drop(columns="_group").assign(sequence_id=sequence, offset=offset, _fill=fill)
        return one

    done, numbered = [], 0
    tokens = rows.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    while True:
        if order:
            dealt = _in_ranges(rows, order, groups)
        else:
            dealt = rows.withColumn("_group", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(groups)).cast("int"))
        result = stored(dealt.groupBy("_group").applyInPandas(pack(numbered), schema), "packed")
        loose = F.col("_fill") < SETTLED * capacity
        fewer = -(-(result.filter(loose).agg(F.sum("length")).first()[0] or 0) // group_tokens)
        if groups == 1 or fewer == 0 or fewer >= groups:
            done.append(result)
            break
        done.append(result.filter(~loose))
        rows, groups, numbered = result.filter(loose).select(names), fewer, numbered + 1
    total = done[0]
    for more in done[1:]:
        total = total.unionByName(more)
    total = total.drop("_fill")
    return _numbered_in(total, order).select([c for c in total.columns if c != order]) if order else total


def op5_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(pieces(documents(spark, folder)), "pieces")
    return packed(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
