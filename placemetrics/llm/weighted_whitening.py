"""Whitening of embeddings over their distinct vectors.

Rows whose vector is null or holds a null or a non-finite entry drop out.  An entry c becomes
the whole number floor(64 c) + 1000000.  Equal vectors x are counted once with their number;
sums S and covariance V are weighted by that number (or by one, ``weighted=False``), centred
before they are multiplied; every distinct vector is projected on the leading eigenvectors of
V once and joined back to its rows.

Defined results: an empty table gives no rows.  Vectors have one length, the most frequent
among the rows (of equally frequent ones the longest); others, empty vectors, and entries of
2^55 or more, whose whole numbers no long holds, drop out.  Components whose eigenvalue is zero within double precision do not
exist: there may be fewer than 32, and none where all vectors are equal.  A deviation beyond
38 digits, or beyond a long in the query, is null.  Repeated ids and rows are kept each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.llm.common import importable, stored

SCALE, SHIFT = 64, 1_000_000
#: Entries times SCALE from here on have no place in a long.
LARGEST = 2.0**61
COMPONENTS = 32
#: Vectors with at least this share of all rows are broadcast: at most 1 / HEAVY of them.
HEAVY = 1e-3
#: Values handled at once in a task.
VALUES = 1 << 21
#: Tasks' sums that meet in one group on the first round of adding up.
TOGETHER = 64


def whole_vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of their whole-number vectors) of the usable rows, by length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        entries = values[starts[rows][:, None] + np.arange(n)]
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(entries * SCALE)
            usable = (np.abs(scaled) < LARGEST).all(axis=1)
        yield rows[usable], scaled[usable].astype(np.int64) + SHIFT


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector's bytes, 4 for an entry where all fit; equal vectors have equal bytes.

    The first byte tells the width.
    """
    small = x.astype("<i4")
    return [b"4" + narrow.tobytes() if fits else b"8" + wide.astype("<i8").tobytes()
            for narrow, wide, fits in zip(small, x, (small == x).all(axis=1), strict=True)]


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).astype(np.int64)


def keyed(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Per usable row: vec_id, ``dims``, 128-bit ``key`` of its vector, the vector's bytes ``x``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1)):
                data = packed(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(np.full(len(x), x.shape[1]), pa.int32()),
                    pa.array([hashlib.blake2b(d, digest_size=16).digest() for d in data], pa.binary()),
                    pa.array(data, pa.binary())], names=["vec_id", "dims", "key", "x"])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, F.col(vector).cast("array<double>").alias("x")).mapInArrow(read, f"vec_id {kind}, dims int, key binary, x binary")


def added_up(distinct: DataFrame, columns: list[str], dims: int,
             of_block: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: bool) -> np.ndarray:
    """The sum over all rows of a task's matrices ``of_block(x, weights)``, one row of it per dimension.

    Tasks emit their sums by matrix row; Spark adds them in two rounds, so that a group holds
    at most TOGETHER or tasks / TOGETHER rows of a matrix.  ``exact`` adds whole numbers.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = None, 0
        for batch in batches:
            step = max(1, VALUES // dims)
            for k in range(0, len(batch), step):
                part = batch.slice(k, step)
                x = np.stack([unpacked(d) for d in part.column(0).to_pylist()])
                w = np.asarray(part.column(1).to_pylist(), dtype=np.int64)
                here = of_block(x, w)
                total = here if total is None else total + here
                task = task or zlib.crc32(part.column(0)[0].as_py())
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([task >> 2] * len(total), pa.int32()),
                 pa.array([encoded(row) for row in total], pa.binary())], names=["i", "task", "row"])

    def encoded(row: np.ndarray) -> bytes:
        return ",".join(map(str, row.tolist())).encode() if exact else np.asarray(row, "<f8").tobytes()

    def decoded(data: bytes) -> np.ndarray:
        return np.array([int(v) for v in data.split(b",")], object) if exact else np.frombuffer(data, "<f8")

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array(
            [encoded(sum(decoded(d) for d in table.column("row").to_pylist()))], pa.binary())})

    parts = distinct.select(*columns).mapInArrow(local, "i int, task int, row binary")
    some = parts.groupBy("i", (F.col("task") % TOGETHER).alias("some")).applyInArrow(added, "i int, row binary")
    whole = some.groupBy("i").applyInArrow(added, "i int, row binary").collect()
    return np.stack([decoded(r.row) for r in sorted(whole, key=lambda r: r.i)]) if whole else np.zeros((0, dims))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, the whole part taken off exactly."""
    return (x - np.array([s // n for s in sums], np.int64)) - np.array([(s % n) / n for s in sums])


def squared_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Per row the sum over dimensions of (n x - S)^2, exact."""
    most = n * (abs(x).max(initial=0) + max((abs(s) // n + 1 for s in sums), default=0))
    if int(most) ** 2 * x.shape[1] < 2**62:
        apart = n * x - sums.astype(np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = x.astype(object) * n - sums
    return [sum(v * v for v in row) for row in apart]


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors by column, those above rounding error, COMPONENTS at most."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:COMPONENTS]
    values, vectors = values[order], vectors[:, order]
    real = values > max(values[0] * len(covariance) * np.finfo(float).eps * 16, 0) if len(values) else []
    return values[real], vectors[:, real]


def whitened(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", weighted: bool = True) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    ``weighted=False`` fits on each distinct vector once.  The driver holds dims x dims sums
    and the eigenvectors, whatever the number of rows; the rows' side of the last join is an id
    and 16 bytes.  ``identity_error`` is measured on the whitened vectors themselves.
    """
    session = rows.sparkSession
    importable(session)
    all_keyed = keyed(rows, id_column, vector)
    counted = all_keyed.groupBy("dims", "key").agg(F.count(F.lit(1)).alias("count"), F.first("x").alias("x"))
    counted = stored(counted, "vectors")
    lengths = counted.groupBy("dims").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims, n_rows = lengths or (0, 0)
    weight = F.col("count") if weighted else F.lit(1).cast("bigint")
    distinct = counted.filter(F.col("dims") == dims).withColumn("weight", weight)
    n = n_rows if weighted else distinct.count()

    def sums_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        safe = int(np.abs(x).max()) * int(w.sum()) < 2**63
        return (w @ x if safe else w.astype(object) @ x.astype(object)).astype(object)[:, None]

    sums = added_up(distinct, ["x", "weight"], max(dims, 1), sums_of, exact=True)
    sums = sums[:, 0] if n else np.zeros(dims, object)

    def products_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        apart = centred(x, n, sums)
        return (apart * w[:, None]).T @ apart

    covariance = added_up(distinct, ["x", "weight"], dims, products_of, exact=False) / n if n else np.zeros((0, 0))
    values, vectors = components(covariance) if len(covariance) else (np.zeros(0), np.zeros((0, 0)))
    turn = vectors / np.sqrt(values) if len(values) else vectors

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, VALUES // dims)
            for k in range(0, len(batch), step):
                part = batch.slice(k, step)
                x = np.stack([unpacked(d) for d in part.column("x").to_pylist()])
                z = centred(x, n, sums) @ turn
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), part.column("count"), part.column("weight"),
                    pa.array([str(v) for v in squared_deviation(x, n, sums)]),
                    pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))],
                    names=["key", "count", "weight", "deviation", "z"])

    done = stored(distinct.select("key", "count", "weight", "x").mapInArrow(
        project, "key binary, count bigint, weight bigint, deviation string, z array<double>")
        if len(values) else distinct.selectExpr("key", "count", "weight", "'' AS deviation", "array(0D) AS z").limit(0), "whitened")
    error = _identity_error(done, n, len(values))
    explained = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values]) if len(values) else F.array(F.lit(0.0))
    result = F.struct("deviation", "z")
    heavy = done.filter(F.col("count") >= HEAVY * n_rows).select("key", result.alias("heavy"))
    light = done.filter(F.col("count") < HEAVY * n_rows).select(F.col("key").alias("rare"), result.alias("light"))
    found = all_keyed.select("vec_id", "key").join(F.broadcast(heavy), "key", "left")
    # rows that have their result already are dealt by id, under keys that no vector has
    spread_out = F.concat(F.lit("already found, row "), F.col("vec_id").cast("string")).cast("binary")
    found = found.join(light, F.when(F.col("heavy").isNull(), F.col("key")).otherwise(spread_out) == F.col("rare"), "left")
    found = found.select("vec_id", F.coalesce("heavy", "light").alias("found")).filter("found IS NOT NULL")
    spread = found.select("vec_id", F.col("found.deviation").alias("deviation"), F.posexplode("found.z").alias("at", "whitened"))
    return spread.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"),
                         F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened",
                         F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def _identity_error(done: DataFrame, n: int, width: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    if not width:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            if len(batch):
                z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                w = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                total += (z * w[:, None]).T @ np.c_[z, np.ones(len(z))]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = done.select("weight", "z").mapInArrow(moments, "sums array<double>")
    rows = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(width * (width + 1))
    for row in rows:
        total[row["at"]] = row["value"]
    total = total.reshape(width, width + 1) / n
    mean = total[:, -1]
    return float(np.abs(total[:, :-1] - np.outer(mean, mean) - np.eye(width)).max())


def op13_weighted_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
