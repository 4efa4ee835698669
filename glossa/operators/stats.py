"""Contingency tables, mutual information, column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(terms: DataFrame, examples: DataFrame, term: str = "term") -> DataFrame:
    """(term, p, q, c, n_pos, n_neg): positive, negative and all documents with the term. terms: (doc_id, term), distinct; examples: (doc_id, y), y = 1 is positive."""
    totals = examples.agg(F.sum((F.col("y") == 1).cast("long")).alias("n_pos"), F.sum((F.col("y") != 1).cast("long")).alias("n_neg"))
    counts = terms.join(examples.select("doc_id", "y"), "doc_id").groupBy(term).agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") != 1).cast("long")).alias("q"), F.count(F.lit(1)).alias("c"))
    return counts.crossJoin(F.broadcast(totals))  # one row of totals


def mutual_information(counts: DataFrame, term: str = "term") -> DataFrame:
    """(term, mi), with one pseudo-document of either class; 0 log 0 is 0."""
    p, q, c, pos, neg = (F.col(x).cast("double") for x in ("p", "q", "c", "n_pos", "n_neg"))
    n = pos + neg + 2

    def part(nij: Column, ni: Column, nj: Column) -> Column:
        return F.when(nij == 0, F.lit(0.0)).otherwise(nij / n * F.log2(n * nij / (ni * nj)))

    mi = part(p + 1, c + 2, pos) + part(pos - p, n - c - 2, pos) + part(q + 1, c + 2, neg) + part(neg - q, n - c - 2, neg)
    return counts.select(term, mi.alias("mi"))


def column_stats(dense: DataFrame, vec: str = "vec") -> DataFrame:
    """(dim, mean, std) of an array column; the deviation is the population's, and 1 where it is 0."""
    at = dense.select(F.posexplode(vec).alias("dim", "v"))
    std = F.stddev_pop("v")
    return at.groupBy("dim").agg(F.avg("v").alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"))


def standardize(dense: DataFrame, stats: DataFrame, beta: float = 1.0, vec: str = "vec") -> DataFrame:
    """(x - mean) / std * beta for each dimension. stats has one row for each dimension and becomes one row."""
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    return dense.crossJoin(F.broadcast(packed)).withColumn(vec, F.zip_with(vec, "_s", lambda x, s: (x - s["mean"]) / s["std"] * beta)).drop("_s")


def norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def average_norm(dense: DataFrame, vec: str = "vec") -> DataFrame:
    """(beta): mean length of the rows."""
    return dense.agg(F.avg(norm(vec)).alias("beta"))


def scaling_factor(sparse: DataFrame, dense: DataFrame, vec: str = "vec") -> DataFrame:
    """(scale): mean length of the sparse rows over that of the dense rows, times ten."""
    s = sparse.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("n")).agg(F.avg("n").alias("a"))
    d = dense.agg(F.avg(norm(vec)).alias("b"))
    return s.crossJoin(d).select((F.col("a") / F.col("b") * 10).alias("scale"))


def density(weights: DataFrame, rows: int, columns: int) -> DataFrame:
    """(nnz, density) of a long matrix."""
    n = F.count(F.when(F.col("w") != 0, 1))
    return weights.agg(n.alias("nnz"), (n / F.lit(float(rows) * columns)).alias("density"))


def repetitions(scores: DataFrame) -> DataFrame:
    """(mean, std) of an accuracy over repetitions."""
    return scores.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))
