"""Mixing sources to target weights by proportionate-fair scheduling.

Each source's documents form blocks.  Time runs in slots of one block.  Block k of a source with
weight w (all weights together are 1) is released at floor(k / w) and due at ceil((k + 1) / w);
each slot goes to the released block that is due first.  At any time every source then has less
than one block more or less than w of the slots so far.  Weights are whole numbers of a common
denominator, 2^40 where the products fit a long, so releases and deadlines are exact.

Slots are worked out in frames of FRAME slots, side by side.  How many blocks a source has by the
border of two frames is w times the slots, rounded down or up: up where most of the next block is
due, and never fewer than at the border before.  When a source has no block left a phase ends, and the others share
the slots after it by their weights.

Only counts per source go through the driver, and the borders of at most FRAMES frames and two
phases a source.  A block holds BLOCK_DOCS documents, more in tables that would have more
than FRAMES * FRAME blocks.  All rows are kept.  A null source is a source of its own.  With
more than MAX_SOURCES sources, those with fewest rows form a pool with the sum of
their target weights; the pool's blocks are scheduled among its members in the same way, in
groups of groups where there are many.  A pooled source is less than one block from its share
of its pool's blocks, and the pool less than one block from its share.
Ties and repeated rows each have a place of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placemetrics.llm.common import documents, parts, small_table, stored

BLOCK_DOCS = 32
FRAME, FRAMES = 1024, 4096
MAX_SOURCES = 256
#: Common denominator of the weights, and what its product with a number of slots stays below.
DENOMINATOR, LARGEST = 1 << 40, 1 << 62
#: Target weights without a list: rows of the source to this power.
TEMPERING = 0.7
#: Rows of one source that are numbered together, about.
NUMBERED = 10_000
POOLED = "*"


def whole_weights(weights: list[float], denominator: int) -> np.ndarray:
    """Whole numbers in proportion to the weights by largest remainder, one at least, together ``denominator``."""
    total = sum(weights)
    exact = [max(w / total * denominator, 1.0) for w in weights]
    out = [int(x) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    left = denominator - sum(out)
    step = 1 if left > 0 else -1
    while left:  # a few units, or those that the smallest weights were raised by
        for i in order if step > 0 else sorted(order, key=lambda i: -out[i]):
            if left and out[i] + step >= 1:
                out[i] += step
                left -= step
            if not left:
                break
    return np.array(out, np.int64)


def border(weights: np.ndarray, denominator: int, t: int, before: np.ndarray) -> np.ndarray | None:
    """Blocks of each source by slot ``t``: rounded shares, none below ``before``; None if there is no such border."""
    least, part = np.divmod(weights * t, denominator)
    held = np.maximum(least, before)
    room = t - int(held.sum())
    if room < 0:
        return None
    open_now = np.flatnonzero((part > 0) & (held == least))
    first = open_now[np.argsort(-part[open_now], kind="stable")][:room]
    held[first] += 1
    return held


@dataclass(frozen=True)
class Phase:
    """Names, whole weights and blocks already done of the sources of a phase, its first slot, and its frames.

    A frame is (its first slot within the phase, blocks of each source by then, blocks of each in it).
    """

    names: list[str]
    weights: np.ndarray
    denominator: int
    used: np.ndarray
    base: int
    frames: list[tuple[int, np.ndarray, np.ndarray]]


def phases(blocks: dict[str, int], weights: dict[str, float], frame: int = FRAME) -> list[Phase]:
    """Phases until all blocks have a slot."""
    left, used, base, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        names = sorted(left)
        total = sum(left.values())
        denominator = max(len(names), min(DENOMINATOR, LARGEST // max(total, 1)))
        whole, most = whole_weights([weights[s] for s in names], denominator), np.array([left[s] for s in names], np.int64)
        # until the first source ends; then all its blocks are due
        length = min(total, min(-(-int(n) * denominator // int(w)) for n, w in zip(most, whole, strict=True)))
        frames, at, done = [], 0, np.zeros(len(names), np.int64)
        for t in [*range(frame, length, frame), length]:
            now = border(whole, denominator, t, done)
            if now is None and t < length:
                continue  # the frame goes on to the next border
            now = np.minimum(most, whole * t // denominator + 1 if now is None else now)
            frames.append((at, done, now - done))
            at, done = t, now
        out.append(Phase(names, whole, denominator, np.array([used[s] for s in names], np.int64), base, frames))
        base += int(done.sum())
        for s, n in zip(names, done.tolist(), strict=True):
            used[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return out


def _slots() -> F.Column:
    """Per slot of a frame (source, block of the phase): earliest deadline first among released blocks.

    Columns: jobs, an array of (i, done, quota, weight) for the sources with blocks in the
    frame; at, the frame's first slot; denominator.
    """
    jobs, d = F.col("jobs"), F.col("denominator")

    def exact(job, k):
        n, w = job["done"] + k, job["weight"]
        return F.call_function("div", n * d, w), F.call_function("div", (n + 1) * d + w - 1, w)

    def step(state, t):
        def one(job, place):
            k = F.get(state["k"], place)
            release, deadline = exact(job, k)
            return F.when(k < job["quota"], F.struct((release > F.col("at") + t).alias("early"), deadline.alias("due"), place.alias("place"), k.alias("k")))

        return F.array_min(F.transform(jobs, one))

    def take(state, t):
        return F.transform(F.array(step(state, t)), lambda c: F.struct(
            F.transform(state["k"], lambda k, place: k + F.when(place == c["place"], 1).otherwise(0)).alias("k"),
            F.concat(state["out"], F.array(F.struct(c["place"].alias("place"), c["k"].alias("k")))).alias("out")))[0]

    start = F.struct(F.transform(jobs, lambda _: F.lit(0).cast("bigint")).alias("k"),
                     F.expr("cast(array() as array<struct<place:int,k:bigint>>)").alias("out"))
    length = F.aggregate(jobs, F.lit(0).cast("bigint"), lambda n, job: n + job["quota"])
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), length - 1), start, take, lambda state: state["out"])


def timetable(spark: SparkSession, plans: list[list[Phase]]) -> DataFrame:
    """(key, block, slot, release, deadline): one row per block of all sources of the plans, whose names differ.

    Frames are handed to Spark, which fills their slots.
    """
    columns: dict[str, list] = {c: [] for c in ("at", "denominator", "base", "names", "done", "quota", "weight", "used")}
    for phase in (p for plan in plans for p in plan):
        for at, done, quota in phase.frames:
            here = np.flatnonzero(quota)
            if not len(here):
                continue
            columns["at"].append(at)
            columns["denominator"].append(phase.denominator)
            # slots before this frame: all blocks done by then
            columns["base"].append(phase.base + int(done.sum()) - at)
            columns["names"].append([phase.names[i] for i in here])
            for c, values in (("done", done), ("quota", quota), ("weight", phase.weights), ("used", phase.used)):
                columns[c].append(values[here].tolist())
    lists = {c: pa.array(columns[c], pa.list_(pa.int64())) for c in ("done", "quota", "weight", "used")}
    table = small_table(spark, names=pa.array(columns["names"], pa.list_(pa.string())), **lists,
                        **{c: pa.array(columns[c], pa.int64()) for c in ("at", "denominator", "base")})
    frames = table.repartition(parts(spark), "base", "at", "names").withColumn(
        "jobs", F.arrays_zip("done", "quota", "weight"))
    slots = frames.select("*", F.posexplode(_slots()).alias("t", "chosen"))
    at = F.col("chosen.place")
    k, w, d = F.get("done", at) + F.col("chosen.k"), F.get("weight", at), F.col("denominator")
    return slots.select(
        F.get("names", at).alias("key"), (F.get("used", at) + k).alias("block"), (F.col("base") + F.col("at") + F.col("t")).alias("slot"),
        (F.col("base") + F.call_function("div", k * d, w)).alias("release"),
        (F.col("base") + F.call_function("div", (k + 1) * d + w - 1, w)).alias("deadline"))


def pools(sizes: dict[str, tuple[int, float]]) -> dict[str, dict[str, tuple[int, float]]]:
    """(blocks, target) of each member, for each pool; the pool "" holds all, at most MAX_SOURCES in each."""
    out: dict[str, dict[str, tuple[int, float]]] = {}

    def deal(name: str, members: dict[str, tuple[int, float]]) -> None:
        if len(members) <= MAX_SOURCES:
            out[name] = members
            return
        order, groups = sorted(members), {}
        for k in range(MAX_SOURCES):
            groups[f"{name}.{k}"] = {s: members[s] for s in order[k::MAX_SOURCES]}
        out[name] = {g: (sum(n for n, _ in m.values()), sum(w for _, w in m.values())) for g, m in groups.items()}
        for g, m in groups.items():
            deal(g, m)

    order = list(sizes)
    top = {s: sizes[s] for s in order[: MAX_SOURCES - (len(order) > MAX_SOURCES)]}
    rest = {s: sizes[s] for s in order[len(top) :]}
    if rest:
        top[POOLED] = (sum(n for n, _ in rest.values()), sum(w for _, w in rest.values()))
        deal(POOLED, rest)
    out[""] = top
    return out


def row_hash(docs: DataFrame) -> F.Column:
    """What rows of one source are ordered by."""
    return F.xxhash64("doc_id", "text" if "text" in docs.columns else "doc_id")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, hashed: str | None = None) -> DataFrame:
    """``docs`` plus source_block, place, slot, release and deadline; order by slot, then place.

    ``weights`` by source; sources it leaves out get the smallest weight in it.  Columns of the
    input with these names are replaced.  ``hashed`` names a column with ``row_hash`` of the
    rows, for rows whose text is left out.
    """
    docs = docs.drop("source_block", "place", "slot", "release", "deadline")
    spark, names = docs.sparkSession, docs.columns
    own = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(row, own.alias("own"), (F.col(hashed) if hashed else row_hash(docs)).alias("h"))
    counted = rows.groupBy("own").agg(F.count("*").alias("n"))
    sizes = {r["own"]: r["n"] for r in counted.orderBy(F.desc("n"), "own").collect()}
    if not sizes:
        return docs.withColumns({c: F.lit(None).cast("bigint") for c in ("source_block", "place", "slot", "release", "deadline")})
    given = {("null" if s is None else f"={s}"): w for s, w in (weights or {}).items()}
    target = {s: given.get(s, min(given.values())) if given else n**TEMPERING for s, n in sizes.items()}
    size = max(BLOCK_DOCS, -(-sum(sizes.values()) // (FRAMES * FRAME)))
    tree = pools({s: (-(-n // size), target[s]) for s, n in sizes.items()})
    plans = [phases({s: n for s, (n, _) in m.items()}, {s: w for s, (_, w) in m.items()}) for m in tree.values()]
    blocks = in_the_whole(timetable(spark, plans), {s: pool for pool, m in tree.items() for s in m})
    known = small_table(spark, key=pa.array(list(sizes), pa.string()), of=pa.array(list(sizes.values()), pa.int64()))
    buckets = F.ceil(F.col("of") / NUMBERED)
    dealt = rows.withColumnRenamed("own", "key").join(known, "key").select("row", "key", "h", F.pmod("h", buckets).alias("bucket"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("key", "bucket").agg(F.count("*").alias("n")).select(
        "key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("key", "bucket").orderBy("h", "row.doc_id")
    numbered = dealt.withColumn("n", F.row_number().over(inside)).join(offsets, ["key", "bucket"])
    number = F.col("offset") + F.col("n") - 1
    placed = numbered.select("row", "key", F.floor(number / size).alias("block"), (number % size).alias("place"))
    return placed.join(blocks, ["key", "block"]).select("row.*", F.col("block").alias("source_block"), "place", "slot", "release", "deadline")


def in_the_whole(blocks: DataFrame, pool_of: dict[str, str]) -> DataFrame:
    """The timetable of the sources, with slots of pools turned into slots of the whole.

    A pool's n-th slot is the slot of the pool's n-th block one level up.
    """
    if not any(pool_of.values()):
        return blocks
    blocks = stored(blocks, "timetable")
    above = small_table(blocks.sparkSession, key=pa.array(list(pool_of), pa.string()), pool=pa.array([p or None for p in pool_of.values()], pa.string()))
    now = blocks.join(above, "key")
    levels = 1 + max(p.count(".") + 1 for p in pool_of.values() if p)
    up = now.filter(F.col("key").startswith(POOLED)).select(
        F.col("key").alias("of"), F.col("block").alias("turn"), F.col("pool").alias("next"),
        *[F.col(c).alias(f"up_{c}") for c in ("slot", "release", "deadline")])
    ends = up.groupBy(F.col("of").alias("pool")).agg(F.max("turn").alias("end"))
    now = now.filter(~F.col("key").startswith(POOLED))
    for _ in range(levels - 1):
        now = now.join(ends, "pool", "left")
        # a deadline beyond the pool's last block is that block's
        for c, turn in (("release", F.col("release")), ("deadline", F.least(F.col("deadline") - 1, "end")), ("slot", F.col("slot"))):
            keep = ["of", "turn", f"up_{c}"] + (["next"] if c == "slot" else [])
            now = now.join(up.select(*keep), (F.col("pool") == F.col("of")) & (turn == F.col("turn")), "left").withColumn(
                c, F.coalesce(f"up_{c}", c)).drop("of", "turn", f"up_{c}")
        now = now.withColumn("pool", F.col("next")).drop("next", "end")
    return now.drop("pool")


def in_slots(table: DataFrame) -> DataFrame:
    """The rows dealt to partitions and sorted by slot: files written from it hold the mix in order."""
    n = parts(table.sparkSession)
    last = table.agg(F.max("slot")).first()[0] or 0
    to = F.floor(F.col("slot") * n / F.lit(last + 1)).cast("int")
    return table.repartitionById(n, to).sortWithinPartitions("slot", "place")


def op8_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "source")
    return mixed(docs).select("doc_id", "source", "source_block", "place", "slot", "release", "deadline")
