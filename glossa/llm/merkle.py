"""Merkle manifest of a dataset: a tree of hashes for each key, and a tree over their roots.

Leaves are dealt into blocks of 512 that stand together in the order of their key. A block is one row that holds its
leaves as an ordered array; higher-order functions (sequence, transform, slice, aggregate) collapse its three levels of
eight in place. The roots of the blocks are the leaves of the next round, so a key of any size takes log512 rounds, each
a shuffle of a 512th of the rows before it. Proofs come back down the same way: a block hands each of its nodes the
siblings that it meets on the way to the root.

Places in the order come from a global rank (range partitions, sorted, with a bounded table of offsets), so a key that
holds a third of all rows, or all of them, is spread over tasks like any other; no group is larger than a block.

Defined cases: a null column is written as ``-``, so null and empty texts differ; texts of any length are hashed whole; a
null doc_id sorts first and isn't tampered with; repeated rows are leaves of their own, and rows of equal doc_id go by
their leaf, so their order changes no hash; a null key is a key of its own, before all others; a lone leaf is the root of
its key, and its proof is empty; an empty table gives an empty result and no root; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_rows, clip_columns, lower_ascii, staged, table
from .sharding import global_rank

FAN = 8
#: Levels that a block collapses, and so the nodes that it holds.
LEVELS = 3
BLOCK = FAN**LEVELS
#: Sizes of keys are broadcast up to so many; beyond that the join is dealt out.
BROADCAST_KEYS = 100_000


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(*values: Column) -> Column:
    """Values one behind the other, each as its length in bytes, a colon and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def above(nodes: Column) -> Column:
    """The level above: the hash of every eight nodes in turn, the last ones fewer."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(nodes, r * FAN + 1, F.lit(FAN)), "")))


def steps(height: Column) -> Column:
    """0 to height - 1, the levels that a block collapses; none for height 0."""
    return F.slice(F.array(*[F.lit(j) for j in range(LEVELS)]), F.lit(1), height)


def collapsed(nodes: Column, height: Column) -> Column:
    """All levels of a block, from its nodes up."""
    return F.aggregate(steps(height), F.array(nodes), lambda levels, j: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def siblings(levels: Column, height: Column, i: Column) -> Column:
    """For node i of a block, level by level: the others of its run, those left of it and those right of it."""
    width = F.array(*[F.lit(FAN**j) for j in range(LEVELS)])

    def step(j: Column) -> Column:
        at, nodes = F.floor(i / F.get(width, j)).cast("int"), F.get(levels, j)
        first = at - at % FAN
        return F.struct(F.array_join(F.slice(nodes, first + 1, at - first), "").alias("left"), F.array_join(F.slice(nodes, at + 2, first + (FAN - 1) - at), "").alias("right"))

    return F.transform(steps(height), step)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def placed(spark: SparkSession, nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the place of a node among those of its key k, and ``height``, the levels of the key's tree."""
    ranked = global_rank(spark, nodes, [F.col("k"), *map(F.col, order)], "rank")
    firsts = staged(spark, ranked.groupBy("k").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size")), "firsts")
    few = bounded_rows(firsts, BROADCAST_KEYS)
    powers = F.array(*[F.lit(FAN**j).cast("long") for j in range(20)])
    height = F.size(F.filter(powers, lambda p: p < F.col("size")))
    return ranked.join(firsts if few is None else few, "k").select(*nodes.columns, (F.col("rank") - F.col("first")).alias("at"), height.alias("height"))


def tree(spark: SparkSession, nodes: DataFrame) -> list[DataFrame]:
    """Blocks (k, block, height, rest, rows, levels) round by round, until every key has one. nodes: (k, at, height, h, item)."""
    rounds, left = [], nodes.agg(F.max("height")).first()[0] or 0
    while True:
        blocks = nodes.groupBy("k", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.first("height").alias("all"), F.sort_array(F.collect_list(F.struct("at", "h", "item"))).alias("rows"))
        here = F.least(F.col("all"), F.lit(LEVELS))
        blocks = blocks.select("k", "block", here.alias("height"), (F.col("all") - here).alias("rest"), "rows")
        rounds.append(staged(spark, blocks.withColumn("levels", collapsed(F.transform("rows", lambda x: x["h"]), F.col("height"))), "blocks"))
        left -= LEVELS
        if left <= 0:
            return rounds
        nodes = rounds[-1].select("k", F.col("block").alias("at"), F.col("rest").alias("height"), root_of_block().alias("h"), F.lit(0).alias("item"))


def root_of_block() -> Column:
    return F.get(F.element_at("levels", -1), F.lit(0))


def with_paths(up: Column) -> Column:
    """The nodes of a block with their siblings, from their own runs up; up: those of the block itself."""
    return F.transform("rows", lambda x, i: F.struct(x["at"].alias("at"), x["h"].alias("h"), x["item"].alias("item"), F.concat(siblings(F.col("levels"), F.col("height"), i), up).alias("path")))


def descend(rounds: list[DataFrame], paths: DataFrame | None = None) -> DataFrame:
    """Of every leaf: (k, h, item, path), the siblings up to the root. paths: (k, path, ...) of the roots in a tree above."""
    kept = [c for c in paths.columns if c not in ("k", "path")] if paths is not None else []
    down = paths
    for depth, blocks in enumerate(reversed(rounds)):
        if down is not None:
            blocks = blocks.join(down, ["k", "block"] if depth else "k")
        up = F.col("path") if down is not None else F.array().cast("array<struct<left:string,right:string>>")
        down = blocks.select("k", *kept, F.inline(with_paths(up))).withColumnRenamed("at", "block")
    return down.drop("block")


@dataclass
class Manifest:
    """Blocks of the keys' trees, blocks of the tree over their roots, and its root (None without leaves)."""

    rounds: list[DataFrame]
    tops: list[DataFrame]
    root: str | None

    def proofs(self) -> DataFrame:
        """(k, subroot, h, item, path) of every leaf."""
        return descend(self.rounds, descend(self.tops).select(F.col("item").alias("k"), F.col("h").alias("subroot"), "path"))


def manifest(spark: SparkSession, leaves: DataFrame, order: list[str]) -> Manifest:
    """leaves: (k string, not null; h, the hash; item, what is carried along; and the columns of the order)."""
    tie = leaves.withColumn("_tie", F.monotonically_increasing_id())
    rounds = tree(spark, placed(spark, tie, [*order, "h", "_tie"]).select("k", "at", "height", "h", "item"))
    subroots = rounds[-1].select(F.lit("").alias("k"), F.col("k").alias("item"), root_of_block().alias("h"))
    tops = tree(spark, placed(spark, staged(spark, subroots, "subroots"), ["item"]))
    last = tops[-1].select(root_of_block().alias("h")).first()
    return Manifest(rounds, tops, last.h if last else None)


def key_of(column: Column) -> Column:
    """A key as text that is never null; null comes first, the others in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("+"), column.cast("string")), F.lit(""))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clip_columns(table(spark, sf_dir, "documents"), "doc_id", "source", "lang", "n_chars", "text")
    facts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    seen = F.when(touched, digest(encoded(*facts, lower_ascii(F.col("text")))))
    leaves = docs.select(key_of(F.col("lang")).alias("k"), "doc_id", digest(encoded(*facts, F.col("text"))).alias("h"), F.struct("doc_id", seen.alias("seen")).alias("item"))
    built = manifest(spark, staged(spark, leaves, "hashes"), ["doc_id"])
    of = built.proofs().select(
        F.col("item.doc_id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", F.lit(built.root).alias("root"),
        digest(proof_text(F.col("path"))).alias("proof_sha256"), fold(F.coalesce(F.col("item.seen"), F.col("h")), F.col("path")).alias("folded_root"),
    )
    return of.withColumn("verified", F.col("folded_root") == F.col("root"))


#: op13 for DuckDB: both trees level by level, the siblings of each leaf, and the fold, by recursion.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, *, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS k, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
  || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS facts,
  list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda e, z: xor(e >> 1, 3988292384::UBIGINT * (e & 1)))) AS crc FROM documents),
h AS (SELECT rid, doc_id, k, sha256(facts || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf, sha256(facts || CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END) AS lowered,
  coalesce(xor(crc, 4294967295::UBIGINT) % 3 = 0, false) AS touched FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS p, count(*) OVER (PARTITION BY k) AS n FROM h),
u(step, k, p, n, h) AS (SELECT 0, k, p, n, leaf FROM l UNION ALL
  SELECT step + 1, k, p // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM u WHERE n > 1 GROUP BY step, k, p // 8),
s AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS q, count(*) OVER () AS m FROM u WHERE n = 1),
t(step, p, n, h) AS (SELECT 0, q, m, subroot FROM s UNION ALL SELECT step + 1, p // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM t WHERE n > 1 GROUP BY step, p // 8),
z AS (SELECT l.rid, u.step, u.p < (l.p >> (3 * u.step)) AS before, u.p, u.h FROM l JOIN u ON u.k = l.k AND u.n > 1 AND u.p // 8 = (l.p >> (3 * u.step + 3)) AND u.p <> (l.p >> (3 * u.step)) UNION ALL
  SELECT l.rid, 100 + t.step, t.p < (s.q >> (3 * t.step)), t.p, t.h FROM l JOIN s USING (k) JOIN t ON t.n > 1 AND t.p // 8 = (s.q >> (3 * t.step + 3)) AND t.p <> (s.q >> (3 * t.step))),
a AS (SELECT l.rid, u.step FROM l JOIN u ON u.k = l.k AND u.n > 1 GROUP BY ALL UNION ALL SELECT l.rid, 100 + t.step FROM l, (SELECT DISTINCT step FROM t WHERE n > 1) t),
w AS (SELECT a.rid, a.step, row_number() OVER (PARTITION BY a.rid ORDER BY a.step) AS i, coalesce(g.x, '') AS x, coalesce(g.y, '') AS y FROM a LEFT JOIN
  (SELECT rid, step, string_agg(h, '' ORDER BY p) FILTER (before) AS x, string_agg(h, '' ORDER BY p) FILTER (NOT before) AS y FROM z GROUP BY rid, step) g ON g.rid = a.rid AND g.step = a.step),
f(rid, i, h) AS (SELECT rid, 0, CASE WHEN touched THEN lowered ELSE leaf END FROM l UNION ALL SELECT f.rid, f.i + 1, sha256(w.x || f.h || w.y) FROM f JOIN w ON w.rid = f.rid AND w.i = f.i + 1),
e AS (SELECT rid, max_by(h, i) AS folded FROM f GROUP BY rid),
v AS (SELECT rid, sha256(string_agg(x || y, '' ORDER BY i)) AS proof FROM w GROUP BY rid)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, coalesce(v.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = r.h AS verified
FROM l JOIN s USING (k) JOIN e USING (rid) LEFT JOIN v USING (rid) CROSS JOIN (SELECT h FROM t WHERE n = 1) r
"""
