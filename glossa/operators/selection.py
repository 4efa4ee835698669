"""Rankings, pivots, auxiliary tasks, masks, blocks. Ties go by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import contingency, mutual_information
from .vocab import dense_ids, feature_counts, one_vs_rest, shuffled


def preselected(ranking: DataFrame, fids: DataFrame | None) -> DataFrame:
    return ranking if fids is None else ranking.join(fids.select("fid"), "fid", "left_semi")


def frequency_selector(features: DataFrame, support: int, preselection: DataFrame | None = None) -> DataFrame:
    """(fid, n), most frequent first, of the features with enough support."""
    return preselected(feature_counts(features).where(F.col("n") >= support), preselection).orderBy(F.desc("n"), "fid")


def random_selector(features: DataFrame, seed: int = 0, preselection: DataFrame | None = None) -> DataFrame:
    """(fid) in a seeded random order."""
    return preselected(features.select("fid").distinct(), preselection).orderBy(shuffled(seed, key="fid"), "fid")


def mi_selector(features: DataFrame, examples: DataFrame, preselection: DataFrame | None = None) -> DataFrame:
    """(fid, mi) for two classes (examples: doc_id, y), best first."""
    counts = contingency(features.select("doc_id", "fid"), examples, "fid")
    return preselected(mutual_information(counts, "fid"), preselection).orderBy(F.desc("mi"), "fid")


def round_robin(ranked: DataFrame, item: str = "fid") -> DataFrame:
    """(item, place): rankings (class, rank, item) merged in turns; an item counts where it comes first."""
    turn = F.struct(F.col("rank"), F.col("class"))
    first = ranked.groupBy(item).agg(F.min(turn).alias("_t"))
    return first.select(item, F.col("_t.rank").alias("rank"), F.col("_t.class").alias("class")).orderBy("rank", "class")


def mi_multiclass(features: DataFrame, examples: DataFrame, classes: list, top: int | None = None) -> DataFrame:
    """One-against-rest rankings (examples: doc_id, label) merged in turns. All classes are counted in one pass."""
    totals = examples.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n_pos"))
    n = examples.count()
    seen = features.select("doc_id", "fid").join(examples, "doc_id")
    every = seen.groupBy("fid").agg(F.count(F.lit(1)).alias("c"))
    own = seen.groupBy("fid", F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("p"))
    pairs = every.crossJoin(F.broadcast(totals.where(F.col("class").isin(*classes))))  # a few classes
    counts = pairs.join(own, ["fid", "class"], "left").select("fid", "class", F.coalesce("p", F.lit(0)).alias("p"), (F.col("c") - F.coalesce("p", F.lit(0))).alias("q"), "c", "n_pos", (F.lit(n) - F.col("n_pos")).alias("n_neg"))
    scored = mutual_information(counts.withColumn("key", F.struct("fid", "class")), "key").select("key.fid", "key.class", "mi")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("class").orderBy(F.desc(F.round("mi", 9)), "fid")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return round_robin(ranked)


def binary_rankings(features: DataFrame, examples: DataFrame, classes: list) -> dict[object, DataFrame]:
    """The ranking of each class against the rest."""
    return {c: mi_selector(features, one_vs_rest(examples, c).select("doc_id", "y")) for c in classes}


def select_pivots(ranking: DataFrame, translated: DataFrame, unlabelled: DataFrame, m: int, phi: int) -> DataFrame:
    """(fid_s, fid_t, mi): the first m translatable pivots of which both sides have support phi in the unlabelled data.

    ranking: (fid, mi); translated: (fid_s, fid_t); unlabelled: features of both languages.
    """
    support = feature_counts(unlabelled).where(F.col("n") >= phi).select("fid")
    pairs = ranking.join(translated, ranking["fid"] == translated["fid_s"]).select("fid_s", "fid_t", "mi")
    pairs = pairs.join(support.withColumnRenamed("fid", "fid_s"), "fid_s", "left_semi").join(support.withColumnRenamed("fid", "fid_t"), "fid_t", "left_semi")
    return pairs.orderBy(F.desc(F.round("mi", 9)), "fid_s").limit(m)


def with_prefix(vocab: DataFrame, prefix: str) -> DataFrame:
    return vocab.where(F.col("fname").startswith(prefix))


def auxiliary_tasks(counts: DataFrame, prefixes: list[str], m: int, strict: bool = False) -> DataFrame:
    """(prefix, fid, fname, n, rank): the m most frequent features of each prefix. counts: (fid, fname, n). strict: each prefix must have m."""
    prefix = F.coalesce(*[F.when(F.col("fname").startswith(p), F.lit(p)) for p in prefixes])
    ranked = counts.withColumn("prefix", prefix).where("prefix is not null")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("n"), "fid"))).where(F.col("rank") <= m)
    if strict:
        found = {r.prefix: r["count"] for r in ranked.groupBy("prefix").count().collect()}
        if short := [p for p in prefixes if found.get(p, 0) < m]:
            raise ValueError(f"fewer than {m} features of {', '.join(short)}")
    return ranked.select("prefix", "fid", "fname", "n", "rank")


def location_mask(vocab: DataFrame, location: str) -> DataFrame:
    """The features whose name holds the location between its type and its value."""
    parts = F.split("fname", "[_=]")
    return vocab.where(F.array_contains(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), location))


def feature_type_blocks(vocab: DataFrame) -> DataFrame:
    """(ftype, f_min, f_max, n) of each feature type; ``contiguous`` tells whether the ids have no gap."""
    blocks = vocab.groupBy(F.substring_index("fname", "=", 1).alias("ftype")).agg(F.min("fid").alias("f_min"), F.max("fid").alias("f_max"), F.count(F.lit(1)).alias("n"))
    return blocks.withColumn("contiguous", F.col("f_max") - F.col("f_min") + 1 == F.col("n"))


def pos_filter(tokens: DataFrame, prefixes: list[str], pos: str = "pos") -> DataFrame:
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col(pos).startswith(p)
    return tokens.where(keep)


def top_weights(weights: DataFrame, k: int, group: str = "class_id") -> DataFrame:
    """The k greatest weights of each class or task."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("w"), "fid"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= k)


def sample_probe(examples: DataFrame, seed: int = 0, share: int = 10, key: str = "doc_id") -> DataFrame:
    """One in ``share`` of the examples, to the row, one at least: the first in a seeded order."""
    placed = dense_ids(examples.withColumn("_order", F.concat_ws(":", shuffled(seed, key=key), key)), "_order", "_place")
    return placed.where(F.col("_place") < max(1, examples.count() // share)).drop("_order", "_place")
