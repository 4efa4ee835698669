"""Cross-language classification by structural correspondence learning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decomposition, lexicon, linear, mixing, selection, stats, subspace, vocab
from ..session import written
from ..sources.readers import load_model, save_model
from ..timing import timed


@dataclass
class Model:
    """What prediction needs: vocabulary, theta, and the statistics of projected rows."""

    vocabulary: DataFrame
    theta: DataFrame
    dims: int
    stats: DataFrame
    beta: float
    pivots: DataFrame

    def project(self, bow: DataFrame, side: str) -> DataFrame:
        """(doc_id, vec): projected, standardised, scaled."""
        rows = vocab.l2_normalize(vocab.vectorize(bow, self.vocabulary.where(F.col("side") == side)))
        return stats.standardize(subspace.dense(subspace.project(rows, self.theta), self.dims), self.stats, 1 / self.beta)

    def save(self, path: str) -> None:
        save_model({"vocabulary": self.vocabulary, "theta": self.theta, "stats": self.stats, "pivots": self.pivots}, path, {"dims": self.dims, "beta": self.beta})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        t, facts = load_model(spark, path)
        return cls(t["vocabulary"], t["theta"], facts["dims"], t["stats"], facts["beta"], t["pivots"])


@timed
def train(spark: SparkSession, source: DataFrame, labels: DataFrame, source_free: DataFrame, target_free: DataFrame, dictionary: DataFrame, m: int = 450, phi: int = 30, k: int = 100, reg: float = 1e-5, alpha: float = 0.85, visits: float = 1e6, mindf: int = 2) -> Model:
    """source, source_free, target_free: bags of words (doc_id, term, freq) with ids of their own; labels: (doc_id, y)."""
    if not 0 < k <= m:
        raise ValueError("k must be above zero and at most m")
    voc = vocab.disjoint_vocabularies(vocab.document_frequency(source.unionByName(source_free), mindf), vocab.document_frequency(target_free, mindf))
    voc = written(spark, voc, "vocabulary")
    s_voc, t_voc = (voc.where(F.col("side") == x) for x in "st")
    rows = written(spark, vocab.l2_normalize(vocab.vectorize(source, s_voc)), "rows")
    free_s, free_t = vocab.l2_normalize(vocab.vectorize(source_free, s_voc)), vocab.l2_normalize(vocab.vectorize(target_free, t_voc))
    free = written(spark, free_s.unionByName(free_t), "free")
    ranking = selection.mi_selector(rows, labels)
    pivots = selection.select_pivots(ranking, lexicon.translate(dictionary, s_voc, t_voc), free, m, phi)
    pivots = written(spark, pivots, "pivots")
    found = pivots.orderBy(F.desc(F.round("mi", 9)), "fid_s").collect()
    tasks = spark.createDataFrame([(i, int(f)) for i, r in enumerate(found) for f in (r.fid_s, r.fid_t)], "task_id long, fid long")
    w = mixing.auxiliary(spark, vocab.merge(rows, free), tasks, reg=reg, alpha=alpha, visits=visits, seed=13)
    w = written(spark, w, "auxiliary")
    k = min(k, max(1, len(found)))
    theta, _ = decomposition.truncated_svd(spark, w, k)
    theta = written(spark, theta, "theta")
    projected = written(spark, subspace.dense(subspace.project(vocab.merge(rows, free), theta), k), "projected")
    table = written(spark, stats.column_stats(projected), "moments")
    own = stats.standardize(projected.join(labels.select("doc_id"), "doc_id", "left_semi"), table)
    beta = stats.average_norm(own).first().beta or 1.0
    return Model(voc, theta, k, table, float(beta), pivots)


def evaluate(spark: SparkSession, model: Model, train_bow: DataFrame, train_labels: DataFrame, test_bow: DataFrame, test_labels: DataFrame, repetitions: int = 10, reg: float = 0.01, visits: float = 1e6) -> DataFrame:
    """(repetition, accuracy): a classifier on projected source rows, held against target rows, by shuffles of the source."""
    own, test = (written(spark, subspace.to_sparse(model.project(bow, side)), "projected") for bow, side in ((train_bow, "s"), (test_bow, "t")))
    packed = mixing.pack(own, train_labels)
    weights = mixing.by_seed(spark, packed, list(range(repetitions)), mixing.Descent(reg), linear.epochs_for(visits, packed.rows))
    score = test.join(F.broadcast(weights), "fid").groupBy("task_id", "doc_id").agg(F.sum(F.col("w") * F.col("val")).alias("s"))
    # a row without any weight scores zero, which counts as below
    every = test_labels.join(test_bow.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "y", F.explode(F.array(*[F.lit(i).cast("long") for i in range(repetitions)])).alias("task_id"))
    right = (F.coalesce(F.col("s"), F.lit(0.0)) > 0) == (F.col("y") > 0)
    return every.join(score, ["task_id", "doc_id"], "left").groupBy(F.col("task_id").alias("repetition")).agg((100 * F.avg(right.cast("int"))).alias("accuracy"))
