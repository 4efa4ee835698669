"""SimHash near-duplicates over a hierarchical index in Gray order.

Fingerprints are 64 bits. Sorted by Gray rank (the number whose Gray code the fingerprint is), neighbours differ in few
bits, so a run of them shares many. A node of the index stands for a run and holds the bits that all of it shares, as a
mask and a pattern; upper nodes stand for runs of nodes. A search walks down from the root, adds up the differences on
the bits that each level fixes, and drops a node with all below it as soon as the sum is beyond the radius.

On a cluster: distinct fingerprints are cut into blocks of Gray ranks by an exact histogram; the blocks' masks, at most
some tens of thousands whatever the input, form the upper index that every task holds; a fingerprint travels to the
blocks that survive the walk; each block is searched by its own index. A block returns a star for each local group, never
its pairs; alternating star rounds join the stars.

Defined cases: null and empty texts have fingerprint zero and link with each other like any others; repeated rows share a
fingerprint and so a group; rows without a doc_id get the least doc_id of their group (null if there is none); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import bounded_rows, clip_columns, discard, picked, slices, spare, staged, table
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: A block holds at most so many distinct fingerprints, or a share of all that keeps the number of blocks bounded.
BLOCK = 2048
BLOCKS_LOG2 = 14
FANOUT = 8
ALL = np.uint64(2**64 - 1)


def shingles(text: bytes, n: int) -> list[bytes]:
    """Space-joined word n-grams of a text in lower case, repeats included; a shorter text is one shingle."""
    w = text.lower().split()  # bytes: A-Z, and the six ASCII white-space characters
    if len(w) <= n:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(n)), strict=False)]


def fingerprint(text: bytes, n: int = SHINGLE, once: bool = False) -> int:
    """Bit i is one if it is one in over half of the shingles' hashes.

    once: repeated shingles count once, and where as many are one as zero, the least hash decides; else short texts of an
    even number of shingles would have few ones, and be near each other for that alone.
    """
    found = shingles(text, n)
    return fingerprint_of(np.array([xxhash.xxh64_intdigest(s, SEED) for s in (set(found) if once else found)], np.uint64), once)


def fingerprint_of(h: np.ndarray, once: bool = False) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_ = 2 * ones > len(h)
    if once:
        set_ |= (2 * ones == len(h)) & np.unpackbits(h.min(keepdims=True).view(np.uint8), bitorder="little").astype(bool)
    return int(np.packbits(set_, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", n) for t in b.column("t").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(s))
    return fp


def gray_rank_column(fp: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


class GrayIndex:
    """Levels of (pattern, shared mask) over leaves in Gray order; leaves are fingerprints, or runs with their masks."""

    def __init__(self, ones: np.ndarray, some: np.ndarray) -> None:
        """ones: bits that are one in all of a leaf; some: bits that are one in any of it."""
        self.levels = []
        while True:
            self.levels.append((ones, ~(ones ^ some)))
            if len(ones) <= 1:
                break
            cuts = np.arange(0, len(ones), FANOUT)
            ones, some = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(some, cuts)
        self.levels.reverse()

    def search(self, q: np.ndarray, radius: int, lead: tuple[np.uint64, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, leaf) whose difference on the leaf's shared bits is within the radius, in bounded portions.

        lead: a mask of leading bits, and how many of them may differ.
        """
        n = len(self.levels[-1][0])
        for at in range(0, len(q) if n else 0, step := max(1, (1 << 21) // max(n, 1))):
            part = q[at : at + step]
            who, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            spent, known = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint64)
            first = np.zeros(len(part), np.uint8)
            for depth, (pattern, shared) in enumerate(self.levels):
                if depth:
                    who, spent, known, first = (np.repeat(x, FANOUT) for x in (who, spent, known, first))
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    real = node < len(pattern)
                    who, node, spent, known, first = who[real], node[real], spent[real], known[real], first[real]
                new = (part[who] ^ pattern[node]) & shared[node] & ~known
                spent = spent + np.bitwise_count(new)
                near = spent <= radius
                if lead is not None:
                    first = first + np.bitwise_count(new & lead[0])
                    near &= first <= lead[1]
                who, node, spent, first = who[near], node[near], spent[near], first[near]
                known = shared[node]
            yield who + at, node


def gray_cuts(fps: DataFrame, n: int, block: int = BLOCK) -> np.ndarray:
    """Lowest Gray rank of each block, from a histogram that is refined where it is dense. fps: distinct, (fp, ...)."""
    most = max(block, n >> BLOCKS_LOG2)
    ranks = fps.select(gray_rank_column(F.col("fp")).alias("r"))
    bins: list[tuple[int, int]] = []
    bits, dense = 16, None
    while True:
        level = ranks.select(F.shiftrightunsigned("r", 64 - bits).alias("b"))
        if dense is not None:
            level = level.join(F.broadcast(dense), F.shiftrightunsigned("b", 8) == F.col("p"), "left_semi")
        counted = [(int(b) & (2**64 - 1), c) for b, c in level.groupBy("b").count().collect()]  # at most 2^16 bins, or 2^8 in each dense one
        bins += [(b << (64 - bits), c) for b, c in counted if c <= most]
        heavy = [(b,) for b, c in counted if c > most]
        if not heavy:
            break
        dense, bits = fps.sparkSession.createDataFrame([(b - 2**64 if b >= 2**63 else b,) for (b,) in heavy], "p long"), bits + 8
    cuts, held = [0], 0
    for low, c in sorted(bins):
        if held and held + c > most:
            cuts.append(low)
            held = 0
        held += c
    return np.array(cuts, np.uint64)


def local_stars(pairs: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its group) for the groups that pairs of positions form."""
    a, b = pairs
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            break
        label = new
    moved = label != ids
    return ids[moved], label[moved]


def links(spark: SparkSession, nodes: DataFrame, radius: int, lead: tuple[np.uint64, int] | None = None, block: int = BLOCK) -> DataFrame:
    """(u, v): links between ids whose fingerprints differ in at most radius bits, as stars. nodes: (fp, id), fp distinct."""
    cuts = spark.sparkContext.broadcast(gray_cuts(nodes, nodes.count(), block))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(block=np.searchsorted(cuts.value, gray_rank(b["fp"].to_numpy(np.int64).view(np.uint64)), "right") - 1)

    placed = staged(spark, nodes.mapInPandas(place, "fp long, id long, block long"), "gray")
    shared = placed.groupBy("block").agg(F.bit_and("fp").alias("a"), F.bit_or("fp").alias("o")).toPandas().sort_values("block")
    upper = spark.sparkContext.broadcast(tuple(shared[c].to_numpy(np.int64) for c in ("block", "a", "o")))

    def travel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ones, some = upper.value
        index = GrayIndex(ones.view(np.uint64), some.view(np.uint64))
        for b in batches:
            own, fp, ids = (b[c].to_numpy(np.int64) for c in ("block", "fp", "id"))
            yield b.assign(asks=False)
            for who, leaf in index.search(fp.view(np.uint64), radius, lead):
                on = block[leaf] > own[who]
                yield pd.DataFrame({"fp": fp[who[on]], "id": ids[who[on]], "block": block[leaf[on]], "asks": True})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(r=gray_rank(pdf["fp"].to_numpy(np.int64).view(np.uint64))).sort_values(["asks", "r"], kind="stable")
        fp, ids = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["id"].to_numpy(np.int64)
        own = fp[: int((~pdf["asks"]).sum())]
        found_u, found_v = [], []
        for who, leaf in GrayIndex(own, own).search(fp, radius, lead):
            on = who != leaf
            u, v = local_stars((who[on], leaf[on]), ids)
            found_u.append(u)
            found_v.append(v)
        return pd.DataFrame({"u": np.concatenate(found_u), "v": np.concatenate(found_v)}) if found_u else pd.DataFrame({"u": [], "v": []}, dtype="int64")

    sent = placed.mapInPandas(travel, "fp long, id long, block long, asks boolean")
    return sent.groupBy("block").applyInPandas(search, "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of each document."""
    ship(spark)
    marked = staged(spark, fingerprints(docs, shingle), "simhash")
    spare = F.lit(1 << 62)  # ids for fingerprints of which no row has a doc_id
    nodes = staged(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", spare + F.shiftrightunsigned("fp", 2)).alias("id")), "nodes")
    roots = components(spark, links(spark, nodes, radius)).withColumnRenamed("u", "id")
    classes = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("c")).select("fp", F.when(F.col("c") < spare, F.col("c")).alias("component_id"))
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


#: For near copies by shingle similarity: five words, similarity 0.8.
WORDS = 5
SIMILARITY = 0.8
#: Shingles that are common in about so many documents go last in the order of shingles; at most COMMON of them.
SAMPLE_DOCS = 20_000
COMMON = 100_000
#: The share of a set's shingles, first in the order, by which it is looked for; more of them tell more about a set before any pair is made.
PREFIX = 0.3
PEELS = 4
#: In each round, so many times as many members of a bucket lead.
MORE_LEADS = 4
#: A bucket of so many members is large: a pair meets in its first one only. So many large buckets of a set are remembered.
LARGE, REMEMBERED = 16, 24
#: Row numbers are broadcast up to so many; beyond that the join is dealt out.
BROADCAST_ROWS = 2_000_000


def similar(a: bytes, b: bytes, n: int = WORDS, least: float = SIMILARITY) -> bool:
    """Jaccard similarity of the sets of word shingles; texts without words are alike."""
    x, y = set(shingles(a, n)), set(shingles(b, n))
    both = len(x & y)
    return both >= least * (len(x) + len(y) - both)


def set_hashes(text: bytes) -> np.ndarray:
    """Hashes of the set of word shingles, sorted; a text without words has one of its own."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in set(shingles(text, WORDS)) or [b""]], np.uint64))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most common shingles in a sample of the texts. Any such table gives right results."""
    sample = picked(texts, F.col("h"), SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("t").to_pylist():
                yield pa.record_batch([pa.array(set_hashes(t).view(np.int64))], names=["s"])

    top = sample.select("h", "t").dropDuplicates(["h"]).select("t").mapInArrow(run, "s long").groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).toPandas()
    s, n = top["s"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def leading(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a set that come first in the order of all shingles: rare ones by hash, then common ones by count.

    Of two sets of similarity 0.8, with n the size of either, at least 4/5 n are shared. So of the first PREFIX n of either
    at most n/5 aren't, and the first shared ones, (PREFIX - 1/5) n of the smaller set at least, are in both prefixes.
    """
    known, n = common
    level = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        level = np.where(known[at] == h, n[at], 0)
    long = max(len(h) - -(-4 * len(h) // 5) + 1, math.ceil(PREFIX * len(h)))
    return h[np.lexsort((h, level))[:long]]


def least_shared(n: Column, prefix: float) -> Column:
    """Of the first ``prefix`` of its n shingles, a set shares so many with any set of similarity 0.8, whose size is 4/5 n at least."""
    return F.greatest(F.lit(1), F.ceil((prefix - 0.2) * (0.8 if prefix < 1 else 1.0) * n - 1e-6))


def met_by_others(spark: SparkSession, first: DataFrame, prefix: float) -> DataFrame:
    """(id, n, s, m) of the shingles that m > 1 sets have in their prefixes, without sets that share too few of theirs.

    A set that has no partner is dropped with all its shingles, so that others' shingles are alone in turn, and so on;
    after PEELS rounds what is left is looked at pair by pair. first: (id, n, s).
    """
    own = Window.partitionBy("s")
    met = staged(spark, first.withColumn("m", F.count(F.lit(1)).over(own)).where("m > 1"), "met")
    for _ in range(PEELS):
        size = met.count()
        rich = met.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where(F.col("c") >= least_shared(F.col("n"), prefix)).select("id")
        before, met = met, staged(spark, met.drop("m").join(rich, "id", "left_semi").withColumn("m", F.count(F.lit(1)).over(own)).where("m > 1"), "met")
        discard(spark, before)
        if met.count() > 0.9 * size:
            break
    return met


def near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, all columns; groups are components of the pairs of similarity 0.8 or more.

    The documents are numbered and written once, so every later read sees the same numbers, whatever executors are lost.
    Fingerprints are those of the sets of shingles, as is the similarity: else texts that repeat one line look alike.
    Equal texts are one candidate. Links of the fingerprint index, verified by exact similarity, join most of each group.
    What they miss is found exactly. Similar sets share some of their leading shingles, and four fifths of all: sets that
    share too few leading ones with all others together have no partner, nor have, of the rest, sets that share too few of
    all their shingles. Sets that are left meet in the bucket of each of their rarest shingles that could be the first
    shared one. In rounds, members of a bucket lead, those with the most company first, and all members that aren't joined
    to a lead yet are held against it, unless sizes and positions rule the similarity out. Components join what is similar;
    a bucket whose members are all joined is done, and every other one ends with all its pairs held, except for pairs that
    meet in an earlier large bucket.

    Defined cases: null, empty and blank texts are one group; equal texts go without a comparison; a text of fewer than
    five words is one shingle; of a group the least doc_id stays (null ids last), of equal ids the first row; texts of any
    length are compared whole; an empty table stays empty; columns of any name are kept.
    """
    ship(spark)
    number = spare(docs, "_row")
    numbered = staged(spark, docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = numbered.select(F.col(number).alias("row"), "doc_id", text.alias("t"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    common = spark.sparkContext.broadcast(common_shingles(keyed))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in batches for b in slices(whole, "t")):
            sets = [(t, set_hashes(t)) for t in b.column("t").to_pylist()]
            fps = np.array([fingerprint_of(h, True) if t.split() else 0 for t, h in sets], np.uint64)
            first = [leading(h, common.value).view(np.int64) for _, h in sets]
            yield pa.record_batch([b.column("row"), b.column("doc_id").cast(pa.int64()), b.column("h"), pa.array(fps.view(np.int64)), pa.array([len(h) for _, h in sets], pa.int64()), pa.array(first, pa.list_(pa.int64()))], names=["row", "doc_id", "h", "fp", "n", "first"])

    marked = staged(spark, keyed.mapInArrow(mark, "row long, doc_id long, h long, fp long, n long, first array<long>"), "marked")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = staged(spark, marked.groupBy("fp", "h").agg(F.min_by("row", order).alias("row")), "kept")
    copies = staged(spark, marked.select("row", "fp", "h").join(kept.withColumnRenamed("row", "kept"), ["fp", "h"]).where("row <> kept").select("row"), "copies")
    few = copies if (small := bounded_rows(copies, BROADCAST_ROWS)) is None else small

    nodes = staged(spark, kept.groupBy("fp").agg(F.min("row").alias("id")), "nodes")
    same = kept.join(nodes.select("fp", F.col("id").alias("other")), "fp").where("row <> other").select(F.col("row").alias("id"), "other")
    close = staged(spark, same.union(links(spark, nodes, RADIUS).select(F.col("u").alias("id"), F.col("v").alias("other"))), "close")

    first = marked.join(few, "row", "left_anti").select(F.col("row").alias("id"), "n", F.explode("first").alias("s"))
    met = met_by_others(spark, first, PREFIX)
    wanted = staged(spark, met.select("id").union(close.select("id")).union(close.select("other")).distinct(), "wanted")
    narrow = wanted if (small := bounded_rows(wanted, BROADCAST_ROWS)) is None else small
    texts = staged(spark, numbered.select(F.col(number).alias("id"), text.alias("t")).join(narrow, "id"), "texts")
    discard(spark, marked, met, nodes)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in batches for b in slices(whole, "t", 1 << 18)):
            sets = [set_hashes(t) for t in b.column("t").to_pylist()]
            n = np.array([len(h) for h in sets], np.int32)
            yield pa.record_batch([b.column("id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "n", "s"])

    met = met_by_others(spark, texts.mapInArrow(whole, "id long, n int, s long"), 1.0)
    # the order of all shingles from here on: those that only one set has, then by the number of sets. A set's first one
    # that it shares with a similar set is among its first fifth and one more
    own, alone = Window.partitionBy("s"), F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id"))
    placed = met.withColumn("at", alone + F.row_number().over(Window.partitionBy("id").orderBy("m", "s")) - 1).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * 0.8 - 1e-6))
    placed = staged(spark, placed.withColumn("m", F.count(F.lit(1)).over(own)).where("m > 1"), "placed")
    company = placed.groupBy("id").agg((F.sum(F.log("m")) / F.first("n")).alias("company"))
    # a set's first large buckets: what is in both sets' lists, before the bucket at hand, has brought them together already
    crowded = placed.where(F.col("m") >= LARGE).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where(F.col("r") <= REMEMBERED)
    lists = staged(spark, crowded.groupBy("id").agg(F.collect_list(F.struct("at", "s")).alias("large")), "lists")
    earlier = F.when(F.col("m") >= LARGE, F.transform(F.filter("large", lambda x: x["at"] < F.col("at")), lambda x: x["s"])).alias("earlier")
    ranked = placed.join(company, "id").withColumn("k", F.row_number().over(own.orderBy(F.desc("company"), "id"))).join(lists, "id", "left")
    buckets = staged(spark, ranked.select("id", "n", "s", "at", "m", "k", earlier), "buckets")
    discard(spark, met, placed, lists)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in batches for b in slices(whole, "a")):
            alike = [similar(x, y) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
            alike = pa.array(alike, pa.bool_())
            yield pa.record_batch([b.column(c).filter(alike) for c in ("id", "other")], names=["id", "other"])

    def joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The labels after the pairs whose texts are similar are joined."""
        a, b = (texts.select(F.col("id").alias(k), F.col("t").alias(t)) for k, t in (("id", "a"), ("other", "b")))
        alike = staged(spark, pairs.join(b, "other").join(a, "id").select("id", "other", "a", "b").mapInArrow(judge, "id long, other long"), "similar")
        ends = alike.join(labels.select("id", F.col("c").alias("u")), "id").join(labels.select(F.col("id").alias("other"), F.col("c").alias("v")), "other").select("u", "v")
        roots = components(spark, ends).withColumnRenamed("u", "c")
        return staged(spark, labels.join(roots, "c", "left").select("id", F.coalesce("root", "c").alias("c")), "labels")

    labels = joined(wanted.withColumn("c", F.col("id")), close)

    def held(leads: DataFrame, members: DataFrame, once: bool = True) -> DataFrame:
        """Pairs of a lead and a member that isn't joined to it, if sizes and positions let them be similar.

        once: not where both have an earlier large bucket in common, as that one holds them against each other; the first
        one in common is never left out, so no pair is lost.
        """
        leads = leads.select("s", *(F.col(x).alias(f"lead_{x}") for x in ("id", "n", "at", "k", "c", "earlier")))
        # shared shingles: this one, those before it in both, those behind it in both; 4/5 of the union means 9 shared >= 4 (n + n)
        behind = F.least(F.col("n") - F.col("at"), F.col("lead_n") - F.col("lead_at"))
        # a similar pair also meets in the very first shingle that it shares, with none before it
        most = behind if once else behind + F.least("at", "lead_at")
        fits = (F.col("k") > F.col("lead_k")) & (F.col("c") != F.col("lead_c")) & (9 * most >= 4 * (F.col("n") + F.col("lead_n")))
        if once:
            fits = fits & ~F.coalesce(F.arrays_overlap("earlier", "lead_earlier"), F.lit(False))
        return staged(spark, leads.join(members, "s").where(fits).select("id", F.col("lead_id").alias("other")).distinct(), "pairs")

    # first each set in its fullest bucket only: a large group is joined by one comparison a set, not by one in every bucket
    fullest = buckets.groupBy("id").agg(F.max(F.struct("m", "s", "n", "at", "k")).alias("x")).select("id", "x.s", "x.n", "x.at", "x.k", F.lit(None).alias("earlier"))
    named = lambda rows: rows.join(labels, "id")
    labels = joined(labels, held(named(buckets.where("k = 1")), named(fullest), False))
    low, high, open_ = 1, 2, buckets.drop("m")
    while True:
        # a bucket that is done stays done, as components only grow
        before, mixed = open_, open_.drop("c").join(labels, "id").withColumn("mixed", F.min("c").over(own) < F.max("c").over(own)).where("mixed").drop("mixed")
        open_ = staged(spark, mixed, "open")
        discard(spark, buckets if low == 1 else before)
        if not open_.where(F.col("k") > low).limit(1).count():
            break
        labels = joined(labels, held(open_.where((F.col("k") >= low) & (F.col("k") < high)), open_))
        low, high = high, high * MORE_LEADS
    gone = staged(spark, labels.where("id <> c").select(F.col("id").alias("row")).union(copies).withColumnRenamed("row", number), "gone")
    gone = gone if (small := bounded_rows(gone, BROADCAST_ROWS)) is None else small
    return numbered.join(gone, number, "left_anti").drop(number)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
