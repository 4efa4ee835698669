"""Language-model scoring by context-tree weighting, beside a word-frequency baseline.

A text is read as its words in lower case with one space between them, and an end. Each byte is eight binary decisions;
the decision at a node of the byte tree is predicted in the contexts of 0 to DEPTH preceding bytes. Every context keeps
how often each outcome followed it, its Krichevsky-Trofimov estimate, and the weight of its own estimate against those
of its longer contexts, which is the ratio of its block probability to the product of its children's weighted ones. A
prediction mixes the estimates along the context path by these weights, from the longest context that training has seen;
so the code length of a byte is proper: over all bytes the probabilities add up to one.

Nothing is estimated from a part of the corpus. Byte n-grams and words are counted by shuffles that grow with it; block
probabilities go from the leaves to the root, one depth after another, in partitions by the nearest bytes; from the root
down each node meets its parent by a join and learns what all above it make of a probability; with that, every n-gram of
the corpus, seen in training or not, gets its probability where its context is. No part of the tree reaches the driver. Texts aren't shuffled: the HOT most frequent n-grams and words travel to the
tasks (bounded), and what a text holds beyond them is joined to the full tables and added up by document.

Defined cases: null and empty texts hold the end alone; an empty training set gives base scores of N = 0, V = 0 and even
odds for every bit; texts of any length are scored whole; repeated rows are each scored (and each counted, if they train); a null doc_id trains; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import Lookup, clip_columns, crc32_of_id, slices, staged, table

DEPTH = 5
HOT_GRAMS_LOG2 = 20
HOT_WORDS_LOG2 = 19
SLICE_BYTES = 1 << 20
END = 10  # the byte for the end, and for what precedes a text; words hold no line break
#: The nearest bytes by which the deep part of the tree is dealt out, and those by which a task takes it in portions.
SPLIT = 3
CUT = 4
#: A task holds about so many n-grams at once, or those of one context of CUT bytes (2^16 at most).
PORTION = 1 << 17
LOG_HALF = math.log(0.5)
_LOADED: dict = {}


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series, eight steps up."""
    shifted, product = x + 8, np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5) - np.log(product)


def block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each normal text and its end: DEPTH bytes of context, nearest first, then the byte; and where each text ends."""
    pad = bytes([END]) * DEPTH
    raw = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1])) + np.repeat(DEPTH + np.arange(len(texts)) * (DEPTH - 1), size)
    key = np.zeros(len(at), np.uint64)
    for k in range(1, DEPTH + 1):
        key = (key << np.uint64(8)) | raw[at - k]
    return (key << np.uint64(8)) | raw[at], ends


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of the values that go with them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def nodes_of(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The deepest nodes: (context, node of the byte tree) packed in one number, and their outcomes."""
    ids, zeros, ones = [], [], []
    context, byte = keys >> np.uint64(8), keys & np.uint64(255)
    for i in range(8):
        bit = (byte >> np.uint64(7 - i)) & np.uint64(1)
        ids.append((context << np.uint64(8)) | np.uint64(1 << i) | (byte >> np.uint64(8 - i)))
        ones.append(n * bit)
        zeros.append(n * (np.uint64(1) - bit))
    return summed(np.concatenate(ids), np.concatenate(zeros).astype(float), np.concatenate(ones).astype(float))


def parents(ids: np.ndarray, depth: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums over the nodes of ``depth`` that share a context of one byte less."""
    gone = np.uint64(0xFF) << np.uint64(8 * (DEPTH - depth + 1))
    return summed(ids & ~gone, *values)


def weighted_of(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weight ratio, log weighted probability) of nodes whose children's weighted probabilities have the product ``below``."""
    own = block(n0, n1)
    return own - below, np.logaddexp(LOG_HALF + own, LOG_HALF + below)


@dataclass(frozen=True)
class Level:
    """The nodes of one depth: sorted ids, probability of a one, weight of the own estimate."""

    ids: np.ndarray
    one: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, ratio: np.ndarray) -> Level:
        return cls(ids, (n1 + 0.5) / (n0 + n1 + 1), 1 / (1 + np.exp(-np.clip(ratio, -500, 500))))


@dataclass(frozen=True)
class Base:
    """What the depths up to SPLIT make of a probability p from below: shift + scale * p, or ``alone`` if there is none below."""

    ids: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    alone: np.ndarray


def log10_of(keys: np.ndarray, levels: dict[int, Level], base: Base) -> np.ndarray:
    """Logarithm of the probability of each key's byte in its context."""
    out = np.zeros(len(keys))
    context, byte = keys >> np.uint64(8), keys & np.uint64(255)

    def place(d: int, node: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(8 * (DEPTH - d))
        wanted = (((context >> low) << low) << np.uint64(8)) | node
        at = np.searchsorted(ids, wanted).clip(max=len(ids) - 1)
        return at, ids[at] == wanted

    for i in range(8):
        node = np.uint64(1 << i) | (byte >> np.uint64(8 - i))
        p = np.full(len(keys), np.nan)
        for d in range(DEPTH, SPLIT, -1):
            if len(levels[d].ids):
                at, seen = place(d, node, levels[d].ids)
                own, w = levels[d].one[at], levels[d].weight[at]
                p = np.where(~seen, p, np.where(np.isnan(p), own, w * own + (1 - w) * p))
        at, seen = place(SPLIT, node, base.ids)
        if not seen.all():
            raise RuntimeError("a context has no base")
        p = np.where(np.isnan(p), base.alone[at], base.shift[at] + base.scale[at] * p)
        out += np.log10(np.where((byte >> np.uint64(7 - i)) & np.uint64(1) == 1, p, 1 - p))
    return out


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of normal texts, distinct, and how many each has."""
    n = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    joined = b" ".join(t for t in texts if t)
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.nonzero(raw == 32)[0]
    lengths = np.diff(np.concatenate([[-1], gaps, [len(raw)]])) - 1 if len(raw) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(raw[raw != 32].tobytes())]).dictionary_encode(), n


def hashes(words: pa.Array) -> np.ndarray:
    """A signed 64-bit number for each word; the end is the empty word."""
    return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], np.uint64).view(np.int64)


END_HASH = int(np.array([xxhash.xxh64_intdigest(b"")], np.uint64).view(np.int64)[0])


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n, every): kind 0 counts byte n-grams, kind 1 words; n in training texts, every in all. docs: (t binary, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(kind: int, keys: np.ndarray, n: np.ndarray, every: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 1 << 17):
                part = [pa.array(x[k : k + (1 << 17)].astype(np.int64)) for x in (keys, n, every)]
                yield pa.record_batch([pa.array(np.full(len(part[0]), kind, np.int32)), *part], names=["kind", "key", "n", "every"])

        held: list[tuple[np.ndarray, ...]] = []
        ends = 0
        for whole in batches:
            for b in slices(whole, "t", SLICE_BYTES):
                out = np.asarray(b.column("held_out"))
                both = [normal(t or b"") for t in b.column("t").to_pylist()]
                for trains in (True, False):
                    texts = [t for t, o in zip(both, out.tolist(), strict=True) if o != trains]
                    if not texts:
                        continue
                    keys, n = np.unique(keys_of(texts)[0], return_counts=True)
                    held.append((keys, n * trains, n))
                    if trains:
                        ends += len(texts)
                        words, _ = words_of(texts)
                        if len(words):
                            n = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary))
                            yield from batch(1, hashes(words.dictionary), n, n)
                if len(held) >= 8:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        if held:
            yield from batch(0, *summed(*(np.concatenate(x) for x in zip(*held, strict=True))))
        if ends:
            yield from batch(1, *(np.array([x]) for x in (END_HASH, ends, ends)))

    return docs.mapInArrow(run, "kind int, key long, n long, every long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def low_bits(depth: int) -> int:
    """So many bits of a key or node lie below its nearest ``depth`` bytes of context."""
    return 8 * (DEPTH - depth + 1)


def whole_contexts(keys: np.ndarray, depth: int, most: int) -> int:
    """How many of the sorted keys, if they are more than ``most``, belong to contexts of ``depth`` bytes that are complete."""
    low = np.uint64(low_bits(depth))
    return int(np.searchsorted(keys, (keys[-1] >> low) << low)) if len(keys) > most else 0


def portions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and training counts in portions that never divide a context of CUT bytes. batches: sorted by key."""
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for b in batches:
        keys = np.concatenate([keys, b["key"].to_numpy(np.int64).view(np.uint64)])
        n = np.concatenate([n, b["n"].to_numpy(np.int64).view(np.uint64)])
        if cut := whole_contexts(keys, CUT, PORTION):
            yield keys[:cut], n[:cut]
            keys, n = keys[cut:], n[cut:]
    if len(keys):
        yield keys, n


def deep_levels(keys: np.ndarray, n: np.ndarray) -> tuple[dict[int, Level], tuple[np.ndarray, ...]]:
    """Levels DEPTH to CUT of complete contexts, and the nodes of depth CUT with their weighted probabilities, seen in training or not."""
    ids, n0, n1 = nodes_of(keys, n)
    seen = n0 + n1 > 0
    levels = {DEPTH: Level.of(ids[seen], n0[seen], n1[seen], np.zeros(int(seen.sum())))}
    weighted = block(n0, n1)
    for d in range(DEPTH, CUT, -1):
        ids, n0, n1, below = parents(ids, d, n0, n1, weighted)
        ratio, weighted = weighted_of(n0, n1, below)
        seen = n0 + n1 > 0
        levels[d - 1] = Level.of(ids[seen], n0[seen], n1[seen], ratio[seen])
    return levels, (ids, n0, n1, weighted)


def climbed(parts: Iterator[tuple[np.ndarray, ...]], depth: int) -> Iterator[pd.DataFrame]:
    """The nodes of ``depth`` - 1 from those of ``depth`` (ids, n0, n1, weighted), which come in order; only the open context is held."""
    low = np.uint64(low_bits(depth - 1))
    held: tuple[np.ndarray, ...] | None = None

    def frame(ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> pd.DataFrame:
        ratio, weighted = weighted_of(n0, n1, below)
        return pd.DataFrame({"id": ids.view(np.int64), "n0": n0, "n1": n1, "weighted": weighted, "ratio": ratio})

    for part in parts:
        if len(part[0]):
            up = parents(part[0], depth, *part[1:])
            held = up if held is None else summed(*(np.concatenate(x) for x in zip(held, up, strict=True)))
            cut = int(np.searchsorted(held[0], (part[0][-1] >> low) << low))
            if cut:
                yield frame(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
    if held is not None:
        yield frame(*held)


NODES = "id long, n0 double, n1 double, weighted double, ratio double"


def probabilities(spark: SparkSession, ngrams: DataFrame) -> DataFrame:
    """(key, value): the log10 probability of each n-gram's last byte. ngrams: (key, n)."""

    def above(nodes: DataFrame, depth: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from climbed(((b["id"].to_numpy(np.int64).view(np.uint64), *(b[c].to_numpy(float) for c in ("n0", "n1", "weighted"))) for b in batches), depth)

        dealt = nodes.select("id", "n0", "n1", "weighted").repartition(F.shiftright("id", low_bits(depth - 1))).sortWithinPartitions("id")
        return staged(spark, dealt.mapInPandas(run, NODES), f"depth{depth - 1}")

    def deep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from climbed((deep_levels(keys, n)[1] for keys, n in portions(batches)), CUT)

    context = F.shiftright("key", low_bits(SPLIT))
    dealt = ngrams.select("key", "n").repartition(context).sortWithinPartitions("key")
    depths = {SPLIT: staged(spark, dealt.mapInPandas(deep, NODES), f"depth{SPLIT}")}
    for d in range(SPLIT, 0, -1):
        depths[d - 1] = above(depths[d], d)
    # from the root: what a node and those above it make of a probability from below; each node meets its parent by an equi-join
    mixed = None
    for d in range(SPLIT + 1):
        own, w, seen = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1), 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), "ratio")))), F.col("n0") + F.col("n1") > 0
        if mixed is None:
            nodes = depths[0].withColumns({"shift": F.lit(0.0), "scale": F.lit(1.0), "alone": F.lit(0.5)})
        else:
            gone = 0xFF << low_bits(d)
            nodes = depths[d].withColumn("up", F.col("id").bitwiseAND(F.lit(~gone))).join(mixed.withColumnRenamed("id", "up"), "up")
        mixed = nodes.select(
            "id",
            F.when(seen, F.col("shift") + F.col("scale") * w * own).otherwise(F.col("shift")).alias("shift"),
            F.when(seen, F.col("scale") * (1 - w)).otherwise(F.col("scale")).alias("scale"),
            F.when(seen, F.col("shift") + F.col("scale") * own).otherwise(F.col("alone")).alias("alone"),
        )

    def value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("key", "n", "shift", "scale", "alone")
        nodes, grams = [], []
        low = np.uint64(low_bits(SPLIT))

        def valued(keys: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
            whole = pd.concat(nodes)
            base = Base(whole["key"].to_numpy(np.int64).view(np.uint64), *(whole[c].to_numpy(float) for c in columns[2:]))
            levels = deep_levels(keys, n)[0]
            for k in range(0, len(keys), 1 << 16):
                part = keys[k : k + (1 << 16)]
                yield pd.DataFrame({"key": part.view(np.int64), "value": log10_of(part, levels, base)})
            # contexts behind the last key are done with
            nodes[:] = [whole[base.ids >= (keys[-1] >> low) << low]]

        for b in batches:  # by context: its nodes, then its n-grams
            nodes.append(b[b["n"] < 0][list(columns)])
            grams.append(b[b["n"] >= 0])
            if sum(map(len, grams)) > PORTION:
                keys = np.concatenate([x["key"].to_numpy(np.int64).view(np.uint64) for x in grams])
                n = np.concatenate([x["n"].to_numpy(np.int64).view(np.uint64) for x in grams])
                if cut := whole_contexts(keys, CUT, PORTION):
                    yield from valued(keys[:cut], n[:cut])
                    grams = [pd.DataFrame({"key": keys[cut:].view(np.int64), "n": n[cut:].view(np.int64)})]
                else:
                    grams = [pd.DataFrame({"key": keys.view(np.int64), "n": n.view(np.int64)})]
        keys = np.concatenate([np.zeros(0, np.uint64), *(x["key"].to_numpy(np.int64).view(np.uint64) for x in grams)])
        if len(keys):
            yield from valued(keys, np.concatenate([x["n"].to_numpy(np.int64).view(np.uint64) for x in grams]))

    none = F.lit(None).cast("double")
    both = mixed.select(F.col("id").alias("key"), F.lit(-1).cast("long").alias("n"), "shift", "scale", "alone").union(ngrams.select("key", F.col("n").cast("long"), none, none, none))
    return both.repartition(context).sortWithinPartitions(context, F.col("n") >= 0, "key").mapInPandas(value, "key long, value double")


def least_of_most(rows: DataFrame, n: str, most: int) -> int:
    """The lowest count such that at most ``most`` rows have it or more, from a histogram of counts."""
    size = F.length(F.bin(n)) * 8 + F.call_function("shiftright", F.col(n) * 8, F.length(F.bin(n)) - 1) % 8  # eight steps for each doubling
    held, least = 0, 1 << 62
    for r in rows.groupBy(size.alias("k")).agg(F.count(F.lit(1)).alias("c"), F.min(n).alias("least")).orderBy(F.desc("least")).collect():
        if held + r.c > most:
            break
        held, least = held + r.c, r.least
    return least


def collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a bounded table, packed by the tasks, so that the driver holds two arrays and no rows. rows: (key long, value double)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([np.asarray(b.column(0)).tobytes()]), pa.array([np.asarray(b.column(1)).tobytes()])], names=["k", "v"])

    got = rows.mapInArrow(pack, "k binary, v binary").collect()
    return np.frombuffer(b"".join(bytes(r.k) for r in got), np.uint64), np.frombuffer(b"".join(bytes(r.v) for r in got), np.float64)


def held_out(doc_id: Column) -> Column:
    return crc32_of_id(doc_id) % 5 == 1


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). The counts and scores of every document; see op7 for the columns."""
    ship(spark)
    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("t"))
    counted = staged(spark, counts(docs.select("t", "held_out")), "counts")
    words = counted.where("kind = 1").select("key", "n")
    train_tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = words.where(F.col("key") == END_HASH).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    grams = staged(spark, probabilities(spark, counted.where("kind = 0").select("key", "n")), "grams")
    every = counted.where("kind = 0").select("key", "every")
    least_gram, least_word = least_of_most(every, "every", 1 << HOT_GRAMS_LOG2), least_of_most(words, "n", 1 << HOT_WORDS_LOG2)
    hot_grams = collected(grams.join(every.where(F.col("every") >= least_gram), "key").select("key", "value"))
    hot = [(hot_grams[0], hot_grams[1].astype(np.float32)), collected(words.where(F.col("n") >= least_word).select("key", F.col("n").cast("double")))]
    shared = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _LOADED.get("for") is not shared.value:
            _LOADED.update({"for": shared.value, "by": [Lookup(*x) for x in shared.value]})
        by_gram, by_word = _LOADED["by"]

        def lists(doc: np.ndarray, keys: np.ndarray, n: int) -> pa.Array:
            """For each text the distinct keys, and how often it holds them."""
            order = np.lexsort((keys, doc))
            doc, keys = doc[order], keys[order]
            first = np.nonzero(np.append(True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])))[0] if len(keys) else np.zeros(0, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))).astype(np.int64))], ["key", "n"])
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=n))]).astype(np.int32)), pairs)

        for whole in batches:
            for b in slices(whole, "t", SLICE_BYTES):
                texts = [normal(t or b"") for t in b.column("t").to_pylist()]
                keys, ends = keys_of(texts)
                value = by_gram.get(keys)
                gone = np.nonzero(np.isnan(value))[0]
                value[gone] = 0
                total = np.add.reduceat(value.astype(float), np.concatenate([[0], ends[:-1]]))
                words, size = words_of(texts)
                h = hashes(words.dictionary).view(np.uint64) if len(words) else np.zeros(0, np.uint64)
                index = np.asarray(words.indices) if len(words) else np.zeros(0, np.int64)
                found = by_word.get(h)
                known = ~np.isnan(found)
                found = np.where(known, np.log10(np.where(known, found, 1).astype(float) + 0.5), 0.0)
                doc = np.repeat(np.arange(len(texts)), size)
                rare = ~known[index]
                yield pa.record_batch(
                    [b.column("row"), b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(size + 1), pa.array(np.bincount(doc, known[index], len(texts)).astype(np.int64)), pa.array(np.bincount(doc, found[index], len(texts)).astype(float)), pa.array(total),
                     lists(np.searchsorted(ends, gone, "right"), keys[gone], len(texts)), lists(doc[rare], h[index[rare]], len(texts))],
                    names=["row", "doc_id", "held_out", "n_tokens", "hot", "base", "score", "grams", "words"],
                )

    scored = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, hot long, base double, score double, grams array<struct<key: long, n: long>>, words array<struct<key: long, n: long>>")
    scored = staged(spark, scored, "scored")
    asked = scored.select("row", F.lit(0).alias("kind"), F.inline("grams").alias("key", "times")).union(scored.select("row", F.lit(1), F.inline("words")))
    values = grams.select(F.lit(0).alias("kind"), "key", "value").union(words.select(F.lit(1), "key", F.log10(F.col("n") + 0.5)))
    rest = asked.join(values, ["kind", "key"], "left").groupBy("row").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("times") * F.col("value"))).alias("more_score"),
        F.sum(F.when(F.col("kind") == 1, F.col("times") * F.coalesce("value", F.lit(math.log10(0.5))))).alias("more_base"),
        F.sum(F.when((F.col("kind") == 1) & F.col("value").isNotNull(), F.col("times"))).alias("more"),
    )
    z = math.log10(train_tokens + 0.5 * (distinct + 1))
    return scored.drop("grams", "words").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot") + F.coalesce("more", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + math.log10(ends + 0.5) - F.col("n_tokens") * z).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
