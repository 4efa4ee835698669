"""Truncated SVD of a long sparse matrix: range finder and QR tree (TSQR) over blocks of rows.

The matrix has many rows (features) and a bounded number m of columns (tasks). Rows stand in blocks of fixed ranges of ids,
each packed once as sparse binary columns. A pass multiplies every block by a basis of at most l columns; what blocks give
is combined within a task first, and then in a tree of groups of FAN, so neither a task nor the driver ever holds more than
FAN matrices of m x l, or of l x l. If m is at most l the QR tree of the rows themselves decides, exactly, in one pass; else
subspace iteration from a fixed random start finds the leading right vectors first, until they stand still. Several
matrices, one for each range of features, go through the same jobs.

Defined cases: rows and columns of zeros don't count; ranks below k are filled with zeros; equal singular values have any
basis of their space; a vector's component of the greatest size is positive; without weights there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, written

#: Ids of features in a block of rows; blocks' results that are combined in one task.
ROWS = 4096
FAN = 16
#: Vectors looked for besides the wanted ones, the shift of the subspace that counts as none, and the most rounds.
MORE = 50
STILL, ROUNDS = 1e-9, 300
#: Singular values below this share of the greatest are nothing but rounding.
NOTHING = 1e-12

CHUNKS = "part int, chunk long, fids binary, ptr binary, idx binary, val binary"


def pack(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """CHUNKS of cells (part, fid, c, w): the rows of each range of ids as sparse arrays."""

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fid", "c"])
        fids, first = np.unique(pdf["fid"].to_numpy(np.int64), return_index=True)
        arrays = {"fids": fids, "ptr": np.append(first, len(pdf)).astype(np.int64), "idx": pdf["c"].to_numpy(np.int32), "val": pdf["w"].to_numpy(np.float64)}
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "chunk": pdf["chunk"].iloc[:1].to_numpy(), **{k: [v.tobytes()] for k, v in arrays.items()}})

    return written(spark, cells.withColumn("chunk", F.floor(F.col("fid") / ROWS)).groupBy("part", "chunk").applyInPandas(gathered, CHUNKS), "chunks")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, chunk, fids, ptr, idx, val) of each block."""
    for b in batches:
        for part, chunk, fids, ptr, idx, val in zip(*(b.column(c).to_pylist() for c in ("part", "chunk", "fids", "ptr", "idx", "val")), strict=True):
            yield part, chunk, np.frombuffer(fids, np.int64), np.frombuffer(ptr, np.int64), np.frombuffer(idx, np.int32), np.frombuffer(val)


def times(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The rows times z, in portions of rows so that no array of all values by all columns is made."""
    out = np.empty((len(ptr) - 1, z.shape[1]))
    for at in range(0, len(out), 256):
        to = min(at + 256, len(out))
        a, b = ptr[at], ptr[to]
        dense = np.zeros((to - at, z.shape[0]))
        dense[np.repeat(np.arange(to - at), np.diff(ptr[at : to + 1])), idx[a:b]] = val[a:b]
        out[at:to] = dense @ z
    return out


def transposed_times(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """The transposed rows times y."""
    out = np.zeros((m, y.shape[1]))
    for at in range(0, len(y), 256):
        to = min(at + 256, len(y))
        a, b = ptr[at], ptr[to]
        dense = np.zeros((to - at, m))
        dense[np.repeat(np.arange(to - at), np.diff(ptr[at : to + 1])), idx[a:b]] = val[a:b]
        out += dense.T @ y[at:to]
    return out


def combined(chunks: DataFrame, make: Callable[..., np.ndarray], combine: Callable[[list[np.ndarray]], np.ndarray], columns: int) -> dict[int, np.ndarray]:
    """For each part, what ``combine`` makes of the matrices that ``make`` gives for its blocks; both of so many columns."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for part, chunk, *rows in rows_of(batches):
            new = make(part, *rows)
            held[part] = (chunk, combine([new])) if part not in held else (min(chunk, held[part][0]), combine([held[part][1], new]))
        for part, (chunk, x) in held.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([x.tobytes()])], names=["part", "chunk", "x"])

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        x = combine([np.frombuffer(b).reshape(-1, columns) for b in pdf["x"]])
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "place": [int(pdf["place"].iloc[0]) // FAN], "x": [x.tobytes()]})

    spark = chunks.sparkSession
    level = written(spark, chunks.mapInArrow(first, "part int, chunk long, x binary"), "level")
    # places of a part's results, one for each task that had rows of it
    places = level.select("part", "chunk").orderBy("part", "chunk").toPandas()
    places["place"] = places.groupby("part").cumcount()
    most = int(places["place"].max()) + 1 if len(places) else 0
    level = level.join(F.broadcast(spark.createDataFrame(places)), ["part", "chunk"]).select("part", "place", "x") if most else level
    while most > 1:
        level = level.groupBy("part", F.floor(F.col("place") / FAN).alias("g")).applyInPandas(again, "part int, place long, x binary")
        most = -(-most // FAN)
        if most > 1:
            level = written(spark, level, "level")
    return {r.part: np.frombuffer(r.x).reshape(-1, columns).copy() for r in level.collect()}


def triangle(matrices: list[np.ndarray]) -> np.ndarray:
    """The R of the QR decomposition of the matrices, one below the other."""
    return np.linalg.qr(np.vstack(matrices), mode="r")


def truncated_svd(spark: SparkSession, weights: DataFrame, k: int, blocks: DataFrame | None = None, more: int = MORE) -> tuple[DataFrame, list[list[float]]]:
    """theta (fid, vec) and the spectrum of each block: left singular vectors of W (fid, task_id, w).

    blocks: (block_id, f_min, f_max), ranges of ids that are decomposed each by itself.
    """
    ship(spark)
    weights = weights.where("w <> 0")
    tasks = [r.task_id for r in weights.select("task_id").distinct().orderBy("task_id").collect()]
    bounds = [None] if blocks is None else [(r.f_min, r.f_max) for r in blocks.orderBy("f_min").collect()]
    schema = "fid long, vec array<double>"
    if not tasks:
        return spark.createDataFrame([], schema), [[] for _ in bounds]
    m, l = len(tasks), min(len(tasks), k + more)
    columns = F.broadcast(spark.createDataFrame([(t, c) for c, t in enumerate(tasks)], f"task_id {weights.schema['task_id'].dataType.simpleString()}, c int"))
    part = F.lit(0) if blocks is None else F.coalesce(*[F.when(F.col("fid").between(low, high), F.lit(i)) for i, (low, high) in enumerate(bounds)])
    cells = weights.join(columns, "task_id").select(part.alias("part"), F.col("fid").cast("long").alias("fid"), "c", F.col("w").cast("double").alias("w")).where("part is not null")
    chunks = pack(spark, cells)
    found = [r.part for r in chunks.select("part").distinct().collect()]
    z = {p: np.eye(m) for p in found}
    if l < m:
        z = {p: np.linalg.qr(np.random.default_rng(42).standard_normal((m, l)))[0] for p in found}
        z = subspaces(spark, chunks, z, m, k)
    shared = spark.sparkContext.broadcast(z)
    triangles = combined(chunks, lambda p, fids, ptr, idx, val: times(ptr, idx, val, shared.value[p]), triangle, l)
    spectra, turn = [], {}
    for p in range(len(bounds)):
        if p not in triangles:
            spectra.append([])
            continue
        _, s, vt = np.linalg.svd(triangles[p])
        kept = (s > NOTHING * s[0])[:k].sum()
        spectra.append([float(x) for x in s[:kept]])
        turn[p] = np.zeros((l, k))
        turn[p][:, :kept] = vt[:kept].T / s[:kept]
    turns = spark.sparkContext.broadcast({p: z[p] @ t for p, t in turn.items()})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, _, fids, ptr, idx, val in rows_of(batches):
            u = times(ptr, idx, val, turns.value[p])
            yield pa.record_batch([pa.array(np.full(len(u), p, np.int32)), pa.array(fids), pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), k).cast(pa.list_(pa.float64()))], names=["part", "fid", "vec"])

    u = written(spark, chunks.mapInArrow(vectors, "part int, fid long, vec array<double>"), "left")
    extremes = u.select("part", F.posexplode("vec").alias("d", "v")).groupBy("part", "d").agg(F.max_by("v", F.struct(F.abs("v"), "v")).alias("v"))
    signs = extremes.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", F.when(F.col("v") < 0, -1.0).otherwise(1.0).alias("s")))), lambda x: x["s"]).alias("s"))
    theta = u.join(F.broadcast(signs), "part").select("fid", F.zip_with("vec", "s", lambda a, b: a * b).alias("vec"))
    return theta, spectra


def subspaces(spark: SparkSession, chunks: DataFrame, z: dict[int, np.ndarray], m: int, k: int) -> dict[int, np.ndarray]:
    """Orthonormal bases of the leading right vectors of each part, by subspace iteration until the first k stand still."""
    l = next(iter(z.values())).shape[1]
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(z)
        product = combined(chunks, lambda p, fids, ptr, idx, val: transposed_times(ptr, idx, val, times(ptr, idx, val, shared.value[p]), m), sum, l)
        shift, after = 0.0, {}
        for p, c in product.items():
            e, v = np.linalg.eigh(z[p].T @ c)
            e, v = e[::-1], v[:, ::-1]
            # how far the leading vectors are from what the matrix makes of them, by their own size
            leading = e[:k] > NOTHING * max(e[0], 0)
            ritz, image = z[p] @ v[:, :k][:, leading], c @ v[:, :k][:, leading]
            if leading.any():
                shift = max(shift, float(np.linalg.norm(image - ritz * e[:k][leading], axis=0).max() / max(e[0], 1e-300)))
            after[p] = np.linalg.qr(c @ v)[0]
        shared.unpersist()
        if shift <= STILL:
            return z
        z = after
    raise RuntimeError(f"the subspace still moves by {shift:.1e} after {ROUNDS} rounds")
