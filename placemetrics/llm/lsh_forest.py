"""Near duplicates by an LSH forest over MinHash signatures.

1. Every text becomes its set of shingles; equal sets become one node, named by its smallest
   doc_id.  A node's signature has one minimum per bin of the hash range.
2. The signature bins are dealt to ORDERS sorted orders.  In each order a node meets the rows
   next to it.  A common prefix of LEAST_DEPTH bins is needed; in a crowded region, where many
   rows share that, the depth adapts: only the longest common prefixes count.
3. A crowded region (many rows with one prefix) also compares each row with its hubs: the
   rows that agree most often with the region's commonest key over all orders.
4. Candidates whose signatures agree enough are confirmed on the full sets, first the best
   partner of every node, later only pairs that are not yet connected.
5. Pairs that the forest missed are found exactly, in ``missed``: nodes of different
   components that can reach the limit share a shingle of their prefixes.  Every such pair
   passes the bounds on size, place and bitmap, none of which can rule out a true pair.
   Prefixes hold a set's rarest shingles: common ones are told by a sample of rows, and where
   shingles still crowd, by exact counts over all rows that have them in their prefix.

Set of a text: distinct runs of SIZE words, words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased;
with fewer words the whole sequence.  A text without words, or null, has an empty set, is
linked with nothing and is its own component.  Links and components are between ids: what
rows with one id are linked with counts for all of them.  A set that only rows without id
have is in no component and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placemetrics.llm.common import WHOLE, documents, in_slices, mix, parts, shingle_set, small_table, stored, text_bytes
from placemetrics.llm.components import components

SIZE, PERCENT = 5, 85
BINS, ORDERS, KEY_BINS = 128, 12, 10
LEAST_DEPTH = 3
#: Rows after a row, in each order, that it is compared with.
NEXT = 6
#: Rows after a row in a crowded region that it is compared with if their prefixes tie.
TIES = 2
#: Rows with one prefix from which on a region is crowded, and its hubs.
CROWDED, HUBS = 48, 8
#: Agreement of two signatures below which a pair is not confirmed on the full sets: four
#: standard deviations under PERCENT at 128 bins.
AGREEMENT = 0.70
#: Partners of one node confirmed by one task.
CHUNK = 256
#: Rows whose shingles tell which ones are common, about, and the most that are told.  They set
#: only the order of shingles in prefixes: any order that is the same everywhere finds all pairs.
SAMPLED, COMMON = 4000, 1 << 16
#: Shingles counted exactly that are told besides, at most: 4 MB in every worker.  Further ones
#: stay in the order of their hashes.
COUNTED = 1 << 18
#: They are counted where crowded shingles add more than one row in so many to the cells: counting
#: moves all shingles of the rows that have one.
PAYS = 8
#: Bits of a set's parity bitmap; rows with one shingle that are compared in one group.
PARITY, CELL = 2048, 128

_PERMUTATION = np.random.default_rng(20240229).permutation(BINS)
_KEYS = _PERMUTATION[: ORDERS * KEY_BINS].reshape(ORDERS, KEY_BINS)
_PROBES = np.random.default_rng(7).integers(0, BINS, (64, BINS))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bits of the smallest shingle hash in each bin; an empty bin takes another's."""
    bins = (shingles >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint16)
    full = np.zeros(BINS, bool)
    out[bins[first]] = (mix(shingles[first]) & np.uint64(0xFFFF)).astype(np.uint16)
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    for probe in _PROBES:
        if not len(empty):
            return out
        hit = full[probe[empty]]
        out[empty[hit]] = out[probe[empty[hit]]]
        empty = empty[~hit]
    for k in empty:  # few full bins: walk on to the next one
        out[k] = out[bins[first][np.searchsorted(bins[first], k) % len(first)]]
    return out


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit name and its signature, for every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            counts, names, signatures = [], [], []
            for data in batch.column(1).to_pylist():
                shingles = shingle_set(data, size)
                counts.append(len(shingles))
                names.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                signatures.append(signature(shingles).astype(">u2").tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "name", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("body")).mapInArrow(
        sketch, f"doc_id {kind}, n_shingles bigint, name binary, signature binary")


def forest(nodes: DataFrame) -> DataFrame:
    """(tree, key, node): each node's key in each order."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, WHOLE):
            rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u2").reshape(-1, BINS)
            for tree, bins in enumerate(_KEYS):
                flat = rows[:, bins].astype(">u2").tobytes()
                step = 2 * KEY_BINS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), tree, np.int32)), pa.array([flat[k : k + step] for k in range(0, len(flat), step)], pa.binary()),
                     batch.column("node")], ["tree", "key", "node"])

    return nodes.select("node", "signature").mapInArrow(keys, "tree int, key binary, node bigint")


def _next_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows at most NEXT apart with a common prefix; and the partition's end rows (b is null).

    Where the last CROWDED rows all have the least prefix in common, a pair counts only if it
    has the longest common prefix of one of the two rows, and ties only TIES rows on.
    """
    names = ["a", "b", "tree", "key"]
    tree, keys, node = np.zeros(0, np.int32), np.zeros((0, KEY_BINS), np.uint16), np.zeros(0, np.int64)

    def depth(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(tree[x] == tree[y], np.logical_and.accumulate(keys[x] == keys[y], 1).sum(1), 0)

    started, last = False, None
    for batch in in_slices(batches, WHOLE):
        if not batch.num_rows:
            continue
        if not started:
            head = batch.slice(0, NEXT)
            yield pa.RecordBatch.from_arrays([head.column(2), pa.nulls(head.num_rows, pa.int64()), head.column(0), head.column(1)], names)
            started = True
        kept = len(tree)
        tree = np.r_[tree, batch.column(0).to_numpy()]
        keys = np.r_[keys, np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, KEY_BINS)]
        node = np.r_[node, batch.column(2).to_numpy()]
        beside = np.r_[0, depth(np.arange(len(node) - 1), np.arange(1, len(node)))]  # with the row before
        longest = np.maximum(beside, np.r_[beside[1:], 0])
        found = []
        for step in range(1, NEXT + 1):
            at = np.arange(max(step, kept), len(node))
            common = depth(at - step, at)
            crowded = (at >= CROWDED) & (depth(np.maximum(at - CROWDED, 0), at) >= LEAST_DEPTH)
            good = (common >= LEAST_DEPTH) & (~crowded | ((step <= TIES) & (common >= np.minimum(longest[at], longest[at - step]))))
            found.append(np.stack([node[at[good] - step], node[at[good]]], 1))
        pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
        n = len(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        tree, keys, node = tree[-CROWDED:], keys[-CROWDED:], node[-CROWDED:]
        tail = batch.slice(max(0, batch.num_rows - NEXT))
        last = tail if last is None or tail.num_rows == NEXT else pa.Table.from_batches([last, tail]).combine_chunks().to_batches()[0]
    if last is not None:
        yield pa.RecordBatch.from_arrays([last.column(2), pa.nulls(last.num_rows, pa.int64()), last.column(0), last.column(1)], names)


_PAIR = "a bigint, b bigint, tree int, key binary"


def neighbours(rows: DataFrame) -> DataFrame:
    """(a, b): rows next to each other in an order.  Ends of partitions meet in a second, small pass."""
    n = parts(rows.sparkSession)
    ordered = rows.repartitionByRange(n, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = stored(ordered.mapInArrow(_next_rows, _PAIR), "neighbours")
    ends = found.filter("b is null").select("tree", "key", F.col("a").alias("node")).distinct()
    across = ends.repartition(1).sortWithinPartitions("tree", "key", "node").mapInArrow(_next_rows, _PAIR)
    return found.union(across).filter("b is not null").select("a", "b")


def hub_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each row of a crowded region with the region's hubs."""
    region = ["tree", "prefix"]
    rows = rows.withColumn("prefix", F.substring("key", 1, 2 * LEAST_DEPTH))
    crowded = rows.groupBy(*region).agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select(*region)
    crowded = stored(crowded, "regions")
    inside = stored(rows.join(crowded, region), "crowded")
    keys = inside.groupBy(*region, "key").agg(F.count("*").alias("n"))
    commonest = keys.groupBy(*region).agg(F.max(F.struct("n", "key")).alias("top")).select(*region, F.col("top.key").alias("key"))
    votes = inside.join(commonest, [*region, "key"]).groupBy("node").agg(F.count("*").alias("votes"))
    best = Window.partitionBy(*region).orderBy(F.desc("votes"), "node")
    hubs = inside.join(votes, "node").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= HUBS)
    hubs = hubs.select(*region, F.col("node").alias("hub"))
    return inside.join(hubs, region).filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, agreement) for pairs whose signatures agree in enough bins."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, WHOLE):
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u2").reshape(-1, BINS) for k in (2, 3))
            share = (x == y).mean(1)
            good = pa.array(share >= AGREEMENT)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(good), batch.column(1).filter(good), pa.array(share[share >= AGREEMENT])], ["a", "b", "agreement"])

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("signature").alias(f"{name}_signature"), F.col("n_shingles").alias(f"{name}_n"))

    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    possible = 100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n")
    return both.filter(possible).select("a", "b", "a_signature", "b_signature").mapInArrow(compare, "a bigint, b bigint, agreement double")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    merged = np.concatenate([x, y])
    merged.sort()
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (len(merged) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``percent`` of their union in common.

    The partners of a node arrive in chunks, each behind the node's own text.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in in_slices(batches):
            a, b = [], []
            for node, chunk, partner, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if partner is None:
                    own = own if now == (node, chunk) else []
                    own.append(shingle_set(body, size))  # several where different texts share the id
                    now = (node, chunk)
                elif now == (node, chunk):
                    other = shingle_set(body, size)
                    if any(_alike(mine, other, percent) for mine in own):
                        a.append(node)
                        b.append(partner)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunked = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
    partners = chunked.join(texts, chunked["b"] == texts["node"]).select("a", "chunk", "b", "body")
    own = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    own = own.join(texts, own["a"] == texts["node"]).select("a", "chunk", F.lit(None).cast("bigint").alias("b"), "body")
    ordered = own.union(partners).repartition(parts(pairs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    return ordered.mapInArrow(confirm, "a bigint, b bigint")


def _of_class(size: int):
    """Keeps the texts whose set is the class's own: ids may be repeated."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            names = [xxhash.xxh3_128_digest(shingle_set(data, size).tobytes()) for data in batch.column(2).to_pylist()]
            mask = pa.array([x == y for x, y in zip(names, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask)], ["node", "body"])

    return keep


def _best(pairs: DataFrame) -> DataFrame:
    """Each node's best partner."""
    either = pairs.union(pairs.select("b", "a", "agreement"))
    best = either.groupBy("a").agg(F.max(F.struct("agreement", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that the links so far do not connect."""
    def of(name: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))

    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b", "agreement")


def _shingles(bodies: DataFrame, size: int) -> DataFrame:
    """(shingle, n): how many of the texts (body) have each shingle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, WHOLE):
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(data, size).view(np.int64))], ["shingle"])

    return bodies.select("body").mapInArrow(each, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"))


def _rising(counted: DataFrame, most: int) -> np.ndarray:
    """The ``most`` commonest shingles by rising count."""
    rows = counted.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return rows.column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null").select(F.col("doc_id").alias("node"), text_bytes().alias("body"))


def common_shingles(docs: DataFrame, n: int, size: int) -> np.ndarray:
    """Shingles that several of some SAMPLED of the ``n`` rows have, by rising count."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-n // SAMPLED) or 1)) == 0).select(text_bytes().alias("body"))
    return _rising(_shingles(some, size).filter("n > 2"), COMMON)


def prefixed(bodies: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """(node, name, n, prefix, parity) of every (node, body): the first shingles, common ones last, and a bitmap.

    Two sets with ``percent`` of their union in common share at least ``percent`` of each
    set, hence one of the shingles before the last so many less one.
    """
    ranks = np.argsort(common)
    values = common[ranks]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            names, counts, prefixes, parities = [], [], [], []
            for data in batch.column(1).to_pylist():
                shingles = shingle_set(data, size)
                n = len(shingles)
                names.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                counts.append(n)
                parities.append(np.packbits(np.bincount((shingles >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) % 2 == 1).tobytes())
                if len(values):
                    at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
                    last = np.where(values[at] == shingles, ranks[at] + 1, 0)
                    shingles = shingles[np.argsort(last, kind="stable")]
                prefixes.append(shingles[: n - -(-percent * n // 100) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(parities, pa.binary())], ["node", "name", "n", "prefix", "parity"])

    return bodies.select("node", "body").mapInArrow(rows, "node bigint, name binary, n bigint, prefix array<bigint>, parity binary")


def _possible(percent: int):
    """Pairs (a, b) of rows of a group that can have ``percent`` of their union in common.

    Rows: shingle, lo, hi, mine, node, component, n, place, parity, sorted by the first three.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, bits = np.zeros((0, 8), np.int64), np.zeros((0, PARITY // 64), np.uint64)

        def found(numbers: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (np.diff(numbers[:, :3], axis=0) != 0).any(1)])
            ends = np.repeat(np.r_[starts[1:], len(numbers)], np.diff(np.r_[starts, len(numbers)]))
            out, step = [np.zeros((0, 2), np.int64)], 1
            x = np.flatnonzero(np.arange(len(numbers)) + step < ends)
            while len(x):
                y = x + step
                a, b = numbers[x], numbers[y]
                both = a[:, 6] + b[:, 6]
                common = np.minimum(a[:, 6] - a[:, 7], b[:, 6] - b[:, 7])  # at most, from this shingle on
                good = (a[:, 5] != b[:, 5]) & ((a[:, 1] == a[:, 2]) | (a[:, 3] != b[:, 3]))
                good &= 100 * np.minimum(a[:, 6], b[:, 6]) >= percent * np.maximum(a[:, 6], b[:, 6])
                good &= 100 * common >= percent * (both - common)
                i, j = x[good], y[good]
                apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)  # at most what the sets do not share
                near = apart * (100 + percent) <= (100 - percent) * both[good]
                out.append(np.sort(np.stack([numbers[i[near], 4], numbers[j[near], 4]], 1), 1))
                step += 1
                x = x[x + step < ends[x]]
            pairs = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in in_slices(batches, WHOLE):
            if not batch.num_rows:
                continue
            numbers = np.r_[numbers, np.stack([batch.column(k).to_numpy() for k in range(8)], 1)]
            bits = np.r_[bits, np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(-1, PARITY // 64)]
            cut = int(np.argmax((numbers[:, :3] == numbers[-1, :3]).all(1)))  # the last group may go on
            if cut:
                yield found(numbers[:cut], bits[:cut])
                numbers, bits = numbers[cut:], bits[cut:]
        if len(numbers):
            yield found(numbers, bits)

    return pairs


def _shared(sets: DataFrame) -> DataFrame:
    """(shingle, rows): shingles that prefixes of different components have, and in how many rows."""
    shared = sets.select("component", F.explode("prefix").alias("shingle")).groupBy("shingle").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("rows"))
    return stored(shared.filter("least < most").select("shingle", "rows"), "shared")


def _having(sets: DataFrame, shingles: DataFrame) -> DataFrame:
    """The nodes with one of the shingles in their prefix."""
    each = sets.select("node", F.explode("prefix").alias("shingle"))
    return stored(each.join(shingles, "shingle", "left_semi").select("node").distinct(), "having")


def by_frequency(docs: DataFrame, sets: DataFrame, crowded: DataFrame, common: np.ndarray, nodes: DataFrame,
                 size: int, percent: int) -> DataFrame:
    """``sets`` with shingles put behind others that exact counts tell to be common.

    All shingles of the rows with a crowded one in their prefix are counted.  Those in more than
    CELL rows go to the end of every set, before the ones in ``common``, the commonest last.  A
    prefix without any of them stays as it is in that order, so only the others are made anew.
    """
    bodies = _bodies(docs)
    counted = _shingles(bodies.join(_having(sets, crowded), "node", "left_semi"), size).filter(F.col("n") > CELL)
    counts = _rising(counted, COUNTED)
    counts = counts[~np.isin(counts, common)]
    if not len(counts):
        return sets
    told = small_table(docs.sparkSession, shingle=pa.array(counts.view(np.int64)))
    touched = _having(sets, told)
    anew = prefixed(_texts_of(docs, touched, nodes, size), np.r_[counts, common], size, percent)
    own = stored(sets.join(touched, "node", "left_semi").select("node", "name", "component").distinct(), "own")
    changed = stored(anew.join(own, ["node", "name"]), "prefixes")
    return sets.join(touched, "node", "left_anti").unionByName(changed)


def missed(docs: DataFrame, nodes: DataFrame, labels: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """(a, b): every pair of nodes in different components that the bounds do not rule out.

    A shingle of many nodes is dealt to cells of at most about 2 * CELL rows, each pair to one.
    """
    known = nodes.select("node", "name").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sets = stored(prefixed(_bodies(docs), common, size, percent).join(known, ["node", "name"]), "prefixes")
    shared = _shared(sets)
    told = small_table(docs.sparkSession, shingle=pa.array(common.view(np.int64)))
    crowded = shared.filter(F.col("rows") > 2 * CELL).join(told, "shingle", "left_anti")
    cells = F.ceil(F.col("rows") / CELL)
    added = crowded.agg(F.sum(F.col("rows") * (cells - 1))).first()[0] or 0
    if PAYS * added > (shared.agg(F.sum(F.col("rows") * cells)).first()[0] or 0):
        sets = by_frequency(docs, sets, crowded, common, nodes, size, percent)
        shared = _shared(sets)
    each = sets.select("node", "component", "n", F.posexplode("prefix").alias("place", "shingle"))
    met = each.join(shared, "shingle").withColumn("mine", F.pmod(F.xxhash64("node"), cells))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), cells - 1)))
    group = ["shingle", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine"]
    rows = dealt.select(*group, "node", "component", "n", F.col("place").cast("bigint").alias("place"))
    parity = sets.select("node", "parity").dropDuplicates(["node"])
    rows = rows.join(parity, "node").select("shingle", "lo", "hi", "mine", "node", "component", "n", "place", "parity")
    ordered = rows.repartition(parts(docs.sparkSession), "shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi")
    return stored(ordered.mapInArrow(_possible(percent), "a bigint, b bigint").distinct(), "missed")


def _texts_of(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, body) of the wanted nodes.

    Their ids are stored first, in order, so a few bytes each: Spark sees how few they are and
    leaves the texts of all others where they are.
    """
    ids = stored(wanted.orderBy("node"), "wanted")
    names = stored(nodes.join(ids, "node").select("node", "name"), "named")
    bodies = docs.select(F.col("doc_id").alias("node"), text_bytes().alias("body")).join(ids, "node").join(names, "node")
    return stored(bodies.select("node", "name", "body").mapInArrow(_of_class(size), "node bigint, body binary").distinct(), "texts")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _reachable(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that parity bitmaps as wide as the sets do not rule out; far smaller than the texts."""

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            counts, bits = [], []
            for data in batch.column(1).to_pylist():
                shingles = shingle_set(data, size)
                width = max(64, 1 << (len(shingles) - 1).bit_length())
                counts.append(len(shingles))
                bits.append(np.packbits(np.bincount((shingles >> np.uint64(20)).astype(np.int64) % width, minlength=width) % 2 == 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(bits, pa.binary())], ["node", "n", "bits"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            good = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                while len(y) > len(x):  # halves laid over each other: the bitmap of half the width
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                apart = int(np.bitwise_count(x ^ y).sum(dtype=np.int64))  # at most what the sets do not share
                good.append(apart * (100 + percent) <= (100 - percent) * (n + m))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    sets = stored(texts.mapInArrow(bitmaps, "node bigint, n bigint, bits binary"), "bitmaps")

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_bits", "b_bits")
    return stored(both.mapInArrow(bounded, "a bigint, b bigint").distinct(), "reachable")


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = stored(sketched(docs, size), "sketches")
    classes = sketches.filter("name is not null").groupBy("name").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = stored(classes, "classes")
    nodes = classes.filter("node is not null")
    rows = forest(nodes)
    candidates = stored(agreeing(neighbours(rows).union(hub_pairs(rows)), nodes), "candidates")
    texts = _texts_of(docs, _ends(candidates), nodes, size)
    links = stored(confirmed(_best(candidates), texts, size, percent), "confirmed")
    labels = stored(components(links), "labels")
    for everything in (False, True):
        rest = stored(_apart(candidates, labels), "apart")
        if rest.isEmpty():
            break
        asked = rest.select("a", "b") if everything else _best(rest)
        links = links.union(stored(confirmed(asked, texts, size, percent), "confirmed"))
        labels = stored(components(links), "labels")
    left = missed(docs, nodes, labels, common_shingles(docs, sketches.count(), size), size, percent)
    if not left.isEmpty():
        texts = _texts_of(docs, _ends(left), nodes, size)
        left = _reachable(left, texts, size, percent)
        links = links.union(stored(confirmed(left, texts, size, percent), "confirmed"))
        labels = stored(components(links), "labels")
    found = classes.join(labels, "node", "left").select("name", F.coalesce("component", "node").alias("component"))
    member = sketches.join(found, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return member.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))
