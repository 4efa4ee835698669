"""Structural correspondence: inverted index, labels of auxiliary tasks, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import small
from .vocab import joined
from .vocab import joined


def inverted_index(features: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, doc_id): the documents that hold a feature of the task, a row each, so no list outgrows a row. tasks: (task_id, fid)."""
    return features.select("doc_id", "fid").join(small(tasks.select("task_id", "fid")), "fid").select("task_id", "doc_id").distinct()


def autolabel(examples: DataFrame, features: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, doc_id, y): +1 for documents with a feature of the task, else -1, for every task of a bounded list."""
    hits = inverted_index(features, tasks).withColumn("hit", F.lit(1))
    every = examples.select("doc_id").withColumn("task_id", F.explode(F.array(*[F.lit(int(r.task_id)).cast("long") for r in tasks.select("task_id").distinct().orderBy("task_id").collect()])))
    return every.join(hits, ["task_id", "doc_id"], "left").select("task_id", "doc_id", F.when(F.col("hit") == 1, 1).otherwise(-1).alias("y"))


def masked(features: DataFrame, masks: DataFrame) -> DataFrame:
    """The features without those of the mask: (fid) for all rows, or (task_id, fid) for rows that belong to a task."""
    keys = ["task_id", "fid"] if "task_id" in features.columns and "task_id" in masks.columns else ["fid"]
    return features.join(masks.select(*keys), keys, "left_anti")


def sparse_dot(features: DataFrame, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """(doc_id, score): features without a weight count nothing."""
    return features.join(weights.select("fid", "w"), "fid").groupBy("doc_id").agg((F.sum(F.col("w") * F.col("val")) + bias).alias("score"))


def argmax_class(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, class_id): the class of the greatest score; of equals the greater id. weights: (class_id, fid, w); fid -1 holds a bias."""
    kept = [c for c in ("df",) if c in weights.columns]
    # a feature stays one row: its classes' weights are a list, so rows don't grow before their sums are made in part
    lists = weights.where("fid >= 0").groupBy("fid").agg(F.collect_list(F.struct("class_id", "w")).alias("ws"), *[F.first(c).alias(c) for c in kept])
    part = joined(features, lists, "fid").select("doc_id", "val", F.inline("ws")).groupBy("doc_id", "class_id").agg(F.sum(F.col("w") * F.col("val")).alias("s"))
    # a few classes: each row starts from their biases, so a class without a feature of the row takes part too
    start = F.array(*[F.struct(F.lit(r.class_id).alias("class_id"), F.lit(float(r.b)).alias("b")) for r in weights.groupBy("class_id").agg(F.coalesce(F.sum(F.when(F.col("fid") < 0, F.col("w"))), F.lit(0.0)).alias("b")).orderBy("class_id").collect()])
    every = features.select("doc_id").distinct().select("doc_id", F.inline(start))
    scores = every.join(part, ["doc_id", "class_id"], "left").withColumn("s", F.round(F.coalesce("s", F.lit(0.0)) + F.col("b"), 9))
    return scores.groupBy("doc_id").agg(F.max(F.struct("s", "class_id")).alias("b")).select("doc_id", "b.class_id")


def project(features: DataFrame, theta: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, dim, v): sum of val * theta[fid]. With blocks (block_id, f_min, f_max) each block has dimensions of its own.

    theta: (fid, vec array<double>), vectors of one size, and df, how many rows have the feature, if known. A feature stays one row until the sums: a sum for each dimension,
    partly made before the shuffle, and only the sums are laid out by dimension.
    """
    if (first := theta.select(F.size("vec").alias("k")).first()) is None:
        return features.sparkSession.createDataFrame([], f"doc_id {features.schema['doc_id'].dataType.simpleString()}, dim int, v double")
    rows, by, base = joined(features, theta, "fid", 2_000_000 // max(1, first.k)), ["doc_id"], F.lit(0)
    if blocks is not None:
        # a few blocks: their bounds become one expression, the block of a feature is found in the row
        bounds = [(r.block_id, r.f_min, r.f_max) for r in blocks.orderBy("f_min").collect()]
        rows = rows.withColumn("_b", F.coalesce(*[F.when(F.col("fid").between(low, high), F.lit(b)) for b, low, high in bounds])).where("_b is not null")
        by, base = ["doc_id", "_b"], F.col("_b") * first.k
    sums = rows.groupBy(*by).agg(*[F.sum(F.col("val") * F.col("vec")[i]).alias(f"_{i}") for i in range(first.k)])
    return sums.select(*by, F.posexplode(F.array(*[F.col(f"_{i}") for i in range(first.k)])).alias("_d", "v")).select("doc_id", (base + F.col("_d")).cast("int").alias("dim"), "v")


def dense(projected: DataFrame, dims: int) -> DataFrame:
    """(doc_id, vec): rows as arrays, absent dimensions zero."""
    m = projected.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"))
    return m.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def to_sparse(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """(doc_id, fid, val) of the values that aren't zero."""
    return rows.select("doc_id", F.posexplode(vec).alias("fid", "val")).where("val <> 0").select("doc_id", F.col("fid").cast("long").alias("fid"), "val")
