"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

N-grams stay within a word and its borders; a document holds an n-gram or does not, so long texts don't dilute what
they contain. Document counts by class are taken over about SAMPLE_ROWS labelled training rows, picked by a hash of the
doc_id (all, if there are fewer); n-grams whose share differs between the classes beyond chance and by a factor of
EFFECT become features, scaled by the log-ratio of their smoothed counts. A logistic regression on them is fitted from
the same rows. So the labels that travel are bounded and the texts aren't shuffled.

Defined cases: null and empty texts are scored by the intercept; without labelled rows of both classes the score is 0;
repeated label rows count as often as they occur; texts of any length are scored whole; a label that is null or belongs to no document is left out; repeated
documents are each scored; an empty table gives an empty result; other columns are ignored or passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import bounded_rows, clip_columns, crc32_of_id, picked, spare, staged, table

SIZES = (4, 5, 6)
#: N-grams are counted in so many hashed places.
PLACES_LOG2 = 20
#: About so many labelled rows train the model.
SAMPLE_ROWS = 40_000
#: Standard errors, and the factor, by which a feature's shares must differ.
Z = 4.5
EFFECT = 3.0
RIDGE = 1e-4
THRESHOLD = 0.7
CHUNK_BYTES = 1 << 20


def ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, document) of each n-gram occurrence, for all texts together."""
    if not texts:
        return
    joined = np.frombuffer(b" " + b" ".join(b" ".join(t.lower().split()) + b" " for t in texts) + b"        ", np.uint8)
    spans = np.array([len(b" ".join(t.lower().split())) + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts)), spans)
    n = len(doc)
    key, inner = np.zeros(n, np.uint64), np.zeros(n, np.uint8)
    for k in range(max(SIZES)):
        b = joined[k : k + n]
        key |= b.astype(np.uint64) << np.uint64(8 * k)
        if 0 < k:
            inner += (joined[k - 1 : k - 1 + n] == 32) & (k > 1)  # white space strictly inside the n-gram
        if k + 1 in SIZES:
            good = np.nonzero(inner == 0)[0]
            mixed = (key[good] ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - PLACES_LOG2)).astype(np.int64), doc[good]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size, with the place of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


@dataclass(frozen=True)
class Model:
    """Weights by place of an n-gram; most are zero."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not np.isfinite(self.intercept):
            return np.zeros(len(texts))
        dense = np.zeros(1 << PLACES_LOG2, np.float32)
        dense[self.places] = self.weights
        z = np.full(len(texts), self.intercept)
        for at, part in chunks(texts):
            hits = []
            for place, doc in ngrams(part):
                on = dense[place] != 0
                hits.append((doc[on] << PLACES_LOG2) | place[on])
            once = np.unique(np.concatenate(hits))
            np.add.at(z, at + (once >> PLACES_LOG2), dense[once & ((1 << PLACES_LOG2) - 1)])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, t, y, n) of about ``most`` labelled documents, written once; n tells how often the label occurs."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id", (F.col("toxic") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    known = picked(known, F.xxhash64("doc_id"), most)
    few = known if (small := bounded_rows(known, 2 * most)) is None else small
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")).join(few, "doc_id")
    return staged(spark, rows, "labelled")


def fit(spark: SparkSession, rows: DataFrame) -> Model:
    """rows: (doc_id, t, y, n), training rows only, of bounded number; a row counts n times."""
    ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << PLACES_LOG2), np.int64)
        for b in batches:
            texts, y, weight = b.column("t").to_pylist(), np.asarray(b.column("y")), np.asarray(b.column("n"))
            for at, part in chunks(texts):
                once = np.unique(np.concatenate([(doc << PLACES_LOG2) | place for place, doc in ngrams(part)]))
                doc = at + (once >> PLACES_LOG2)
                np.add.at(held, (y[doc], once & ((1 << PLACES_LOG2) - 1)), weight[doc])
        at = np.nonzero(held.any(0))[0]
        for i in range(0, len(at), 1 << 16):
            k = at[i : i + (1 << 16)]
            yield pa.record_batch([pa.array(k), pa.array(held[1, k].astype(np.int64)), pa.array(held[0, k].astype(np.int64))], names=["place", "p", "q"])

    size = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if len(size) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), float("-inf"))
    counts = rows.mapInArrow(count, "place long, p long, q long").groupBy("place").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    share = (F.col("p") + F.col("q") + 1) / F.lit(size[0] + size[1] + 2.0)
    differs = F.abs(F.col("p") / size[1] - F.col("q") / size[0]) / F.sqrt(share * (1 - share) * (1 / size[1] + 1 / size[0]))
    factor = F.abs(F.log((F.col("p") + 1) / (size[1] + 2.0) / ((F.col("q") + 1) / (size[0] + 2.0))))
    chosen = counts.where((differs > Z) & (factor > math.log(EFFECT))).toPandas().sort_values("place")  # at most one row for each place
    places, p, q = (chosen[c].to_numpy() for c in ("place", "p", "q"))
    ratio = np.log(((p + 1) / (size[1] + 2)) / ((q + 1) / (size[0] + 2)))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << PLACES_LOG2, bool)
        wanted[places] = True
        for b in batches:
            found: list[np.ndarray] = []
            for _, part in chunks(b.column("t").to_pylist()):
                hits = []
                for place, doc in ngrams(part):
                    on = wanted[place]
                    hits.append((doc[on] << PLACES_LOG2) | place[on])
                once = np.unique(np.concatenate(hits))
                cut = np.searchsorted(once, np.arange(len(part) + 1) << PLACES_LOG2)
                found += [(once[i:j] & ((1 << PLACES_LOG2) - 1)).astype(np.int32) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([b.column("y"), b.column("n"), pa.array(found, pa.list_(pa.int32()))], names=["y", "n", "at"])

    got = rows.mapInArrow(present, "y int, n long, at array<int>").toPandas()
    y, weight = got["y"].to_numpy(float), got["n"].to_numpy(float)
    n = np.array([len(x) for x in got["at"]])
    row = np.repeat(np.arange(len(n)), n)
    col = np.searchsorted(places, np.concatenate([*got["at"], np.zeros(0, np.int64)]).astype(np.int64))
    w, b = np.zeros(len(places)), 0.0
    step_w, step_b = np.full(len(places), 1e-8), 1e-8
    for _ in range(400):  # AdaGrad on the whole sample
        z = np.bincount(row, w[col] * ratio[col], len(n)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / max(weight.sum(), 1)
        gw = np.bincount(col, g[row] * ratio[col], len(places)) + RIDGE * w / max(len(places), 1)
        step_w, step_b = step_w + gw**2, step_b + g.sum() ** 2
        w, b = w - 0.5 * gw / np.sqrt(step_w), b - 0.5 * g.sum() / np.sqrt(step_b)
    return Model(places, w * ratio, float(b))


def score(spark: SparkSession, docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """Adds the score to all columns of ``docs``."""
    ship(spark)
    shared, own = spark.sparkContext.broadcast(model), spare(docs, "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(own).to_pylist()]
            columns = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != own]
            yield pa.record_batch([*columns, pa.array(shared.value.score(texts))], names=[*(x for x in b.schema.names if x != own), out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` double"])
    return docs.withColumn(own, F.col(text).cast("binary")).mapInArrow(run, schema)


def held_out() -> Column:
    return crc32_of_id(F.col("doc_id")) % 3 == 1


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that aren't held out."""
    return fit(spark, labelled(spark, docs, labels.where(~held_out())))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = train(spark, docs, clip_columns(table(spark, sf_dir, "labels"), "doc_id", "toxic"))
    out = score(spark, docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
