"""Shards by balanced label propagation; law ``rows``: the shards' row counts are at most one apart.

Documents that share a group (equal texts, or any key given) are linked. Documents of one group in one shard are
interchangeable, so the state is a table of cells (group, shard, rows), never pairs of documents. Every round, each
group's rows want to move to the shard where most of their neighbours are, which cuts the fewest links; how many may
move is a quota for each target shard and size of gain, taken from a bounded histogram, so no shard ever holds more
linked rows than its share. Documents without links fill what is left.

Places follow from two global ranks (range partitions, sorted, with a bounded table of offsets): of a document within its
group, and within its shard. A group beyond any size is spread over tasks like other rows.

Defined cases: a null text has size 1 and the CRC of the empty text, and nulls form one group; texts of any length have their own size; repeated rows each get a
slot of their own; a null doc_id sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clip_columns, offsets, staged, table

SHARDS = 8
ROUNDS = 8


def global_rank(spark: SparkSession, df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the zero-based place in the whole order; only per-partition totals reach the driver."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(spark, placed.withColumn("_part", F.shiftright("_at", 33)), "ranked")
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).toPandas()
    base = spark.createDataFrame([(int(k), int(v)) for k, v in offsets(totals, "_part", "n").items()], "_part long, _base long")
    within = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + within).drop("_at", "_part", "_base")


def propagate(spark: SparkSession, cells: DataFrame, shares: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Cells (g, shard, n) after the rounds; shares: the most linked rows of each shard."""
    for _ in range(rounds):
        target = cells.groupBy("g").agg(F.max_by("shard", F.struct("n", F.xxhash64("g", "shard"))).alias("to"), F.max("n").alias("most"))
        wish = cells.join(target, "g").withColumn("moves", F.col("shard") != F.col("to"))
        # the gain of a move is the number of neighbours there less those here
        wish = wish.withColumn("gain", F.when(F.col("moves"), F.length(F.bin(F.col("most") - F.col("n") + 1))))
        load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        asked = defaultdict(list)
        for r in wish.where("moves").groupBy("to", "gain").agg(F.sum("n").alias("n")).collect():
            asked[r.to].append((r.gain, r.n))
        quota = []
        for to, wants in asked.items():
            room = max(0, shares[to] - load.get(to, 0))
            for gain, n in sorted(wants, reverse=True):
                quota.append((to, gain, min(1.0, room / n)))
                room = max(0, room - n)
        if not any(part > 0 for *_, part in quota):
            return cells
        allowed = F.broadcast(spark.createDataFrame(quota, "to int, gain int, part double"))
        wish = wish.join(allowed, ["to", "gain"], "left").withColumn("go", F.floor(F.col("n") * F.coalesce("part", F.lit(0.0))).cast("long"))
        if not wish.where("go > 0").limit(1).count():
            return cells
        stay = wish.select("g", "shard", (F.col("n") - F.col("go")).alias("n"))
        come = wish.where("go > 0").select("g", F.col("to").alias("shard"), F.col("go").alias("n"))
        cells = staged(spark, stay.union(come).where("n > 0").groupBy("g", "shard").agg(F.sum("n").alias("n")), "cells")
    return cells


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``shard`` and ``slot``. docs: at least ``doc_id`` and a group key ``g`` (not null); further columns are kept."""
    sizes = docs.groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    ranked = staged(spark, global_rank(spark, docs, [F.col("g"), F.col("doc_id")], "_r"), "by_group")
    n = ranked.count()
    share = [n // shards + (s < n % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")
    linked = sizes.where("rows > 1").select("g")
    cells = staged(spark, docs.withColumn("shard", start).groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n")).join(linked, "g", "left_semi"), "cells")
    cells = propagate(spark, cells, share, rounds)
    # one row for each group: where it starts in the ranking, and the shards that take its rows in turn
    taken = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("n", "shard")), asc=False).alias("_cells"))
    # written, so that the join below deals both sides out itself and can split a group of any size
    firsts = staged(spark, ranked.groupBy("g").agg(F.min("_r").alias("_first")).join(taken, "g"), "firsts")
    place = F.col("_r") - F.col("_first")
    chosen = F.aggregate("_cells", F.struct(place.alias("left"), F.lit(None).cast("int").alias("shard")), lambda a, c: F.struct((a["left"] - c["n"]).alias("left"), F.when(a["shard"].isNull() & (a["left"] < c["n"]), c["shard"]).otherwise(a["shard"]).alias("shard")), lambda a: a["shard"])
    named = ranked.join(firsts, "g", "left").withColumn("_to", F.coalesce(F.when(F.col("_cells").isNotNull(), chosen), F.lit(shards))).drop("_cells", "_first", "_r")
    named = global_rank(spark, named, [F.col("_to"), F.col("g"), F.col("doc_id")], "_r")
    counts = {r["_to"]: r.n for r in named.groupBy("_to").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = offsets(pd.DataFrame({"k": range(shards + 1), "n": [counts.get(s, 0) for s in range(shards + 1)]}), "k", "n")
    held = [min(counts.get(s, 0), share[s]) for s in range(shards)]
    # rows beyond a share join those without links; together they fill the shards in turn
    over, rest = {}, 0
    for s in range(shards + 1):
        over[s] = rest
        rest += counts.get(s, 0) - (held[s] if s < shards else 0)
    room, at = [], 0
    for s in range(shards):
        room.append(at)
        at += share[s] - held[s]
    pick = lambda table, key: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in table]), key + 1)
    to = F.col("_to")
    named = named.withColumn("_in", F.col("_r") - pick([first[s] for s in range(shards + 1)], to))
    kept = F.col("_in") < pick([*held, 0], to)
    named = named.withColumn("_free", F.when(~kept, F.col("_in") - pick([*held, 0], to) + pick([over[s] for s in range(shards + 1)], to)))
    # the last shard whose room starts at or before the place and is not empty
    fits = F.lit(0)
    for s in range(shards):
        if share[s] > held[s]:
            fits = F.when(F.col("_free") >= room[s], F.lit(s)).otherwise(fits)
    named = named.withColumn("shard", F.when(kept, to).otherwise(fits).cast("int"))
    slot = F.when(kept, F.col("_in")).otherwise(pick(held, F.col("shard")) + F.col("_free") - pick(room, F.col("shard")))
    return named.withColumn("slot", slot.cast("long")).drop("_to", "_in", "_free", "_r")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.xxhash64(F.col("text")), F.lit(0)).alias("g")
    )
    out = shard_rows(spark, staged(spark, docs, "sizes"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
