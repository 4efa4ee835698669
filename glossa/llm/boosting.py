"""Gradient-boosted trees for two classes: logistic loss, binned features, level-wise trees; on a small dense table, or on
rows that stay on the executors, of which the driver sees sums by node, feature and bin."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged

BINS = 32
#: Gradients are summed as multiples of 1 / SCALE, so sums are the same in any order.
SCALE = 1 << 24
#: A bin that no row is beyond.
NO_CUT = 255
#: Log-odds are written beside the rows after so many trees.
KEPT = 10
#: Rows that a task sums, until there are MOST_TASKS.
ROWS_A_TASK = 50_000
MOST_TASKS = 64


@dataclass
class Boosted:
    """Trees of fixed depth as arrays: node k splits feature[k] at cut[k]; leaves hold the step in log-odds."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            z += leaf[at - len(feature)]
        return z


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Fit on rows x, labels y (0 or 1)."""
    share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    z = np.full(len(x), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = at - first
            best = np.full(n, 1e-9)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key, size = local * BINS + binned[:, f], n * BINS
                gl, hl = (np.cumsum(np.bincount(key, v, size).reshape(n, BINS), 1) for v in (g, h))
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                k = gain[:, : len(c)].argmax(1)
                better = gain[np.arange(n), k] > best
                best = np.where(better, gain[np.arange(n), k], best)
                feature[first : first + n][better] = f
                cut[first : first + n][better] = c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaves = 2**depth
        gs, hs = (np.bincount(at - (leaves - 1), v, leaves) for v in (g, h))
        leaf = -rate * gs / (hs + ridge)
        model.trees.append((feature, cut, leaf))
        z += leaf[at - (leaves - 1)]
    return model


def codes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The bins of all rows, from a column of bytes."""
    return np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(batch.num_rows, width)


def stepped(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Log-odds after some more trees, whose cuts are bins."""
    for feature, cut, leaf in trees:
        z = z + leaf[reached(feature, cut, b, int(np.log2(len(leaf)))) - len(feature)]
    return z


def reached(feature: np.ndarray, cut: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    at = np.zeros(len(b), np.int64)
    for _ in range(levels):
        at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
    return at


def boost_rows(spark: SparkSession, rows: DataFrame, cuts: list[np.ndarray], trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> tuple[Boosted, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Fit on all rows (b, p, n): the bins of a vector as bytes, how many of its n rows have label 1. Also the trees with bins for cuts.

    Every level of a tree is one pass: a task adds up its rows' gradients by node, feature and bin, the driver adds up the tasks.
    """
    width = len(cuts)
    total = rows.agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    share = float(np.clip(total.p / total.n, 1e-4, 1 - 1e-4))
    model, binned = Boosted(float(np.log(share / (1 - share)))), []
    tasks = max(1, min(MOST_TASKS, -(-total.rows // ROWS_A_TASK)))
    held = staged(spark, rows.select("b", "p", "n", F.lit(model.start).alias("z")).repartition(tasks), "boosted")
    since: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def sums(levels: int, feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, n_nodes = list(since), 2**levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gh = np.zeros((2, n_nodes * width * BINS))
            for batch in batches:
                b, (p, n, z) = codes(batch, width), (batch.column(c).to_numpy() for c in ("p", "n", "z"))
                q = 1 / (1 + np.exp(-stepped(before, b, z)))
                each = np.rint(SCALE * (n * q - p)), np.rint(SCALE * n * np.maximum(q * (1 - q), 1e-6))
                node = reached(feature, cut, b, levels) - (n_nodes - 1)
                for f in range(width):
                    key, base = node * BINS + b[:, f], f * n_nodes * BINS
                    for to, v in zip(gh, each, strict=True):
                        to[base : base + n_nodes * BINS] += np.bincount(key, v, n_nodes * BINS)
            yield pa.record_batch([pa.array([gh.astype(np.int64).tobytes()], pa.binary())], names=["gh"])

        whole = np.zeros((2, width, n_nodes, BINS), np.int64)
        for r in held.mapInArrow(run, "gh binary").collect():  # one row of bounded size for each of MOST_TASKS tasks at most
            whole += np.frombuffer(r.gh, np.int64).reshape(whole.shape)
        return whole[0] / SCALE, whole[1] / SCALE

    for _ in range(trees):
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, NO_CUT, np.int64)
        gs = hs = np.zeros(0)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            g, h = sums(level, feature, cut)
            best, chosen = np.full(n, 1e-9), [(0, NO_CUT)] * n
            gl, hl = np.cumsum(g, 2), np.cumsum(h, 2)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gt, ht = gl[f, :, -1:], hl[f, :, -1:]
                gain = gl[f] ** 2 / (hl[f] + ridge) + (gt - gl[f]) ** 2 / (ht - hl[f] + ridge) - gt**2 / (ht + ridge)
                k = gain[:, : len(c)].argmax(1)
                for i in np.nonzero(gain[np.arange(n), k] > best)[0].tolist():
                    best[i], chosen[i] = gain[i, k[i]], (f, int(k[i]))
            for i, (f, k) in enumerate(chosen):
                feature[first + i], cut[first + i] = f, k
            # the leaves are the sides of the last cuts; of a node without one, all is on the left
            left = np.array([min(k, BINS - 1) for _, k in chosen])
            own = [f for f, _ in chosen], np.arange(n)
            gs, hs = (np.stack([x[(*own, left)], x[(*own, BINS - 1)] - x[(*own, left)]], 1).ravel() for x in (gl, hl))
        leaf = -rate * gs / (hs + ridge)
        binned.append((feature, cut, leaf))
        since.append(binned[-1])
        model.trees.append((feature, np.array([np.inf if k == NO_CUT else cuts[f][k] for f, k in zip(feature, cut, strict=True)]), leaf))
        if len(since) == KEPT:
            done, old = list(since), held

            def kept(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.set_column(3, "z", pa.array(stepped(done, codes(b, width), b.column("z").to_numpy())))

            held = staged(spark, old.mapInArrow(kept, old.schema), "boosted")
            discard(spark, old)
            since.clear()
    discard(spark, held)
    return model, binned
