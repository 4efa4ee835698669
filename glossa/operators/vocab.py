"""Vocabularies, bags of words, sparse rows. Long form: bow(doc_id, term, freq), features(doc_id, fid, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def dense_ids(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """Adds ids from ``start`` in the order of a column of distinct values.

    Two levels: rows of a range are numbered within their range, and ranges (as many as partitions) get running bases, so
    no task sees the whole table. The rows are written with their places, so all readers see the same numbers.
    """
    spark = df.sparkSession
    placed = written(spark, df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "ids")
    base, bases = start, []
    for r in placed.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():
        bases.append((r["_p"], base))
        base += r.n
    at = F.broadcast(spark.createDataFrame(bases, "_p long, _base long"))
    return placed.withColumn("_p", F.shiftright("_id", 33)).join(at, "_p").withColumn(name, F.col("_base") + F.col("_id") - F.shiftleft("_p", 33)).drop("_p", "_id", "_base")


def running_totals(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before a row, in the order of columns that tell rows apart.

    Two levels: sums within ranges, and running bases of the ranges, as many as partitions.
    """
    spark = df.sparkSession
    placed = written(spark, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33)), "totals")
    base, bases = 0, []
    for r in placed.groupBy("_p").agg(F.sum(value).alias("n")).orderBy("_p").collect():
        bases.append((r["_p"], base))
        base += r.n
    before = F.sum(value).over(W.partitionBy("_p").orderBy("_id").rowsBetween(W.unboundedPreceding, -1))
    at = F.broadcast(spark.createDataFrame(bases, "_p long, _base long"))
    return placed.withColumn(name, F.coalesce(before, F.lit(0))).join(at, "_p").withColumn(name, (F.col(name) + F.col("_base")).cast("long")).drop("_p", "_id", "_base")


#: Of a table that rows are joined with, so many keys travel to all tasks: those that most rows ask for.
FREQUENT = 300_000


def joined(rows: DataFrame, table: DataFrame, key: str, most: int = FREQUENT) -> DataFrame:
    """Rows with what a table of distinct keys has for them; rows of other keys are left out.

    df: a column of the table that tells how many rows ask for a key; without it the rows are counted, if need be. It is
    dropped. Of a table beyond ``most`` rows the most frequent keys are broadcast, which few words suffice for to serve
    nearly all rows; only the rows of other keys are shuffled. The result is the same either way.
    """
    spark = rows.sparkSession
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table.drop("df")), key)
    if "df" not in table.columns:
        table = written(spark, table.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("df")), key), "asked")
    step = F.floor(F.log2("df") * 8)  # eight steps for each doubling, so that few rows reach the driver
    held, least = 0, None
    for r in table.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("least")).orderBy(F.desc("k")).collect():
        if held + r.n > most:
            break
        held, least = held + r.n, r.least
    if least is None:
        return rows.join(table.drop("df"), key)
    often = F.broadcast(table.where(F.col("df") >= least).drop("df"))
    others = rows.join(F.broadcast(table.where(F.col("df") >= least).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(others.join(table.where(F.col("df") < least).drop("df"), key))


def bag_of_words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, term, freq) of blank-separated terms in lower case. Whole texts are dealt by document, so their terms aren't shuffled."""
    docs = docs.select(key, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    terms = F.filter(F.split(F.lower(F.col(text)), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("freq"))


def document_frequency(bow: DataFrame, mindf: int = 2) -> DataFrame:
    """(term, df) of the terms in at least ``mindf`` documents."""
    return bow.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= mindf)


def disjoint_vocabularies(source: DataFrame, target: DataFrame) -> DataFrame:
    """(side, term, fid), and df if both have it: source terms first, target terms after them, each in the order of terms."""
    kept = [c for c in ("term", "df") if c in source.columns and c in target.columns]
    s = dense_ids(source.select(*kept), "term", "fid")
    t = dense_ids(target.select(*kept), "term", "fid", s.count())
    return s.select(F.lit("s").alias("side"), *kept, "fid").unionByName(t.select(F.lit("t").alias("side"), *kept, "fid"))


def vectorize(bow: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, fid, val): only terms of the vocabulary."""
    kept = [c for c in ("term", "fid", "df") if c in vocab.columns]
    return joined(bow, vocab.select(*kept), "term").select("doc_id", "fid", F.col("freq").cast("double").alias("val"))


def l2_normalize(features: DataFrame) -> DataFrame:
    """Rows of length one; rows of length zero stay."""
    norm = F.sqrt(F.sum(F.col("val") * F.col("val")).over(W.partitionBy("doc_id")))
    return features.withColumn("val", F.when(norm > 0, F.col("val") / norm).otherwise(F.col("val")))


def encode_labels(examples: DataFrame, label: str = "label") -> DataFrame:
    """Adds y: the rank of the label, or -1 and +1 if there are just two. Labels are few: their table is broadcast."""
    classes = examples.select(label).where(F.col(label).isNotNull()).distinct()
    w = W.orderBy(label)
    ranked = classes.select(label, (F.row_number().over(w) - 1).alias("r"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    coded = ranked.select(label, F.when(F.col("n") == 2, 2 * F.col("r") - 1).otherwise(F.col("r")).cast("int").alias("y"))
    return examples.join(F.broadcast(coded), label)


def one_vs_rest(examples: DataFrame, cls: object, label: str = "label") -> DataFrame:
    return examples.withColumn("y", F.when(F.col(label) == cls, 1).otherwise(-1))


def feature_counts(*datasets: DataFrame) -> DataFrame:
    """(fid, n): examples with the feature, over all sets."""
    every = datasets[0].select("fid")
    for d in datasets[1:]:
        every = every.unionByName(d.select("fid"))
    return every.groupBy("fid").agg(F.count(F.lit(1)).alias("n"))


def concat_views(a: DataFrame, b: DataFrame, dim_a: int) -> DataFrame:
    """The features of both views of the same rows; those of b are shifted. The views must have the same rows."""
    na, nb = (d.select("doc_id").distinct().count() for d in (a, b))
    if na != nb:
        raise ValueError(f"views of {na} and {nb} rows")
    return a.select("doc_id", "fid", "val").unionByName(b.select("doc_id", (F.col("fid") + dim_a).alias("fid"), "val"))


def size_mb(features: DataFrame) -> DataFrame:
    """(mb): eight bytes for each value and eight for each row."""
    rows = features.groupBy("doc_id").agg((8 * F.count(F.lit(1)) + 8).alias("b"))
    return rows.agg((F.sum("b") / (1024.0 * 1024.0)).alias("mb"))


def shuffled(seed: int, epoch: int = 0, key: str = "doc_id") -> Column:
    """Sort key of a seeded permutation: a digest that any engine gives alike."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(epoch))))


def merge(*datasets: DataFrame) -> DataFrame:
    out = datasets[0]
    for d in datasets[1:]:
        out = out.unionByName(d)
    return out
