"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is a grouped minimum and an equi-join; the link table is written to the shared folder after it, so lineage
stays short. Nothing is collected but two figures that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged


def _hook(links: DataFrame, larger: bool) -> DataFrame:
    """Each node sends its neighbours (the larger ones, or the smaller ones and itself) to the least of all of them."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if larger else both.where("v < u")
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    sent = seen.where("v > u") if larger else seen
    out = sent.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for each node that has a link; root is the least node of its component. links: (u, v), any order."""
    links = staged(spark, links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = None
    for _ in range(rounds):
        before, links = links, staged(spark, _hook(_hook(links, True), False), "links")
        discard(spark, before)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return links.select("u", F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")
