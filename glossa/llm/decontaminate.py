"""Benchmark decontamination by SimHash windows of item size.

Texts and items are read as runs of letters, digits and characters beyond ASCII, A-Z and the Latin-1 capitals in lower
case. A window of a document has as many words as the
item it is held against; a document shorter than the item is one window, held against all items it could be similar to. Its fingerprint is the SimHash of its five-word shingles, each weighted by how often it occurs;
the fingerprints of the items of that size are indexed by four blocks of 16 bits: two fingerprints within RADIUS differ
by at most RADIUS // 4 bits in some block, so looking up the neighbours of each block finds all of them. What is found
within the radius is verified exactly: weighted Jaccard similarity of the shingles, at least SIMILARITY.

Windows that can't reach the similarity are skipped without a fingerprint: similar windows share most of their shingles
with the item, so a window needs that many shingles of items of its size. This drops nothing that would pass.

Items travel to the tasks in portions of at most ITEM_WORDS words, so what is broadcast is bounded for any benchmark;
documents are read once for each portion and never shuffled.

Defined cases: null and empty documents and items match nothing; items below five words are one shingle and match only
as a whole; of windows of equal similarity the first is given; texts of any length are searched whole; repeated documents
each give their rows, repeated items one for their item_id; empty tables give an empty result; other columns are
ignored, or kept by ``clean``.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import clip_columns, slices, spare, table

SHINGLE = 5
SIMILARITY = 0.8
#: Two texts of similarity 0.8 differ in about 10 bits, with a standard deviation of 3.
RADIUS = 19
BLOCKS = 4
ITEM_WORDS = 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Base of the polynomial hash of a word's bytes, and its inverse modulo 2^64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
SOLID = np.zeros(256, bool)
SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and how many words each text has."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    low = LOWER[raw]
    lead = np.nonzero(raw[:-1] == 0xC3)[0]
    tail = raw[lead + 1]
    low[lead[(tail >= 0x80) & (tail < 0x9F) & (tail != 0x97)] + 1] += 0x20
    solid = SOLID[raw]
    start = np.nonzero(solid[1:] & ~solid[:-1])[0] + 1
    end = np.nonzero(solid[:-1] & ~solid[1:])[0] + 1
    up, down = powers(1 << max(20, len(raw).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    first = np.cumsum(size + 1) - size
    return mixed(h), np.diff(np.searchsorted(start, np.append(first, len(raw))))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """One hash for each run of n words; a shorter text is one shingle."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(31) + words[j : j + len(h)])
    return h


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Fingerprints from how often each bit is one among how many shingles."""
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


@functools.cache
def flips(radius: int, bits: int = 64 // BLOCKS) -> np.ndarray:
    """All patterns of at most ``radius`` ones."""
    out = [0]
    level = [(0, -1)]
    for _ in range(radius):
        level = [(p | 1 << b, b) for p, last in level for b in range(last + 1, bits)]
        out += [p for p, _ in level]
    return np.array(sorted(out), np.int64)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: smaller counts over larger counts."""
    both = sum(min(n, b[k]) for k, n in a.items())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


@dataclass
class Sized:
    """The items of one number of words."""

    ids: list[int] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)

    def build(self) -> None:
        self.fingerprints = np.concatenate([simhash(bits_of(h).sum(0, dtype=np.int64)[None], np.array([len(h)])) for h in self.shingles])
        self.counts = [Counter(h.tolist()) for h in self.shingles]
        self.known = np.unique(np.concatenate(self.shingles))
        own = [((self.fingerprints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(BLOCKS)]
        self.blocks = [(b[order], order) for b in own for order in [np.argsort(b, kind="stable")]]

    def near(self, fp: np.uint64) -> list[int]:
        """Items within the radius: all of them, by the neighbours of each block."""
        found = []
        for k, (slots, items) in enumerate(self.blocks):
            probes = flips(RADIUS // BLOCKS) ^ ((int(fp) >> (16 * k)) & 0xFFFF)
            low, high = np.searchsorted(slots, probes), np.searchsorted(slots, probes, "right")
            found += [items[i:j] for i, j in zip(low[high > low], high[high > low], strict=True)]
        if not found:
            return []
        at = np.unique(np.concatenate(found))
        return at[np.bitwise_count(self.fingerprints[at] ^ fp) <= RADIUS].tolist()


class Index:
    """Items by their number of words, and all their shingles."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.sizes: dict[int, Sized] = defaultdict(Sized)
        for item_id, text in items:
            words, _ = word_hashes([(text or "").encode()])
            if len(words):
                self.sizes[len(words)].ids.append(item_id)
                self.sizes[len(words)].shingles.append(shingle_hashes(words))
        for s in self.sizes.values():
            s.build()
        every = [s.known for n, s in self.sizes.items() if n >= SHINGLE]
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << 20, bool)  # a first look by 20 bits, then the exact one
        self.table[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.short = {n: s for n, s in self.sizes.items() if n < SHINGLE}

    def touched(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold any shingle of any item; all others match nothing."""
        ends = np.cumsum(n)
        found = []
        for k, known in ((SHINGLE, self.known), *((k, s.known) for k, s in self.short.items())):
            if len(known) and len(words) >= k:
                h = shingle_hashes(words, k)
                at = np.arange(len(h)) if k < SHINGLE else np.nonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])[0]
                at = at[np.isin(h[at], known)]
                text = np.searchsorted(ends, at, "right")
                found.append(text[at + k <= ends[text]])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
        """(number of the text, its hits) for the texts that have any."""
        words, n = word_hashes(texts)
        ends = np.cumsum(n)
        for k in self.touched(words, n).tolist():
            if hits := self.hits(words[ends[k] - n[k] : ends[k]]):
                yield k, hits

    def hits(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, end word, similarity): the best window of each item."""
        best: dict[int, tuple[float, int, int]] = {}
        h = shingle_hashes(words)
        maybe = np.nonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])[0] if len(words) >= SHINGLE else np.zeros(0, np.int64)
        if len(maybe):
            maybe = maybe[np.isin(h[maybe], self.known)]
        for n, s in self.sizes.items():
            if n > len(words):
                self._whole(s, n, len(words), h, best)
                continue
            if n < SHINGLE:
                at = np.nonzero(np.isin(shingle_hashes(words, n), s.known))[0]
                span, hashes = 1, shingle_hashes(words, n)
            else:
                span, hashes = n - SHINGLE + 1, h
                if not len(maybe):
                    continue
                mine = maybe[np.isin(h[maybe], s.known)]
                least = int(np.ceil(2 * span * SIMILARITY / (1 + SIMILARITY) - 1e-9))
                if len(mine) < least:
                    continue
                # windows with enough shingles: those that start where `least` of ours end within the span
                close = np.nonzero(mine[least - 1 :] - mine[: len(mine) - least + 1] < span)[0]
                starts = [np.arange(max(0, mine[c + least - 1] - span + 1), min(mine[c], len(h) - span) + 1) for c in close.tolist()]
                at = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
            if not len(at):
                continue
            for run in np.split(at, np.nonzero(np.diff(at) > span)[0] + 1):
                for k in range(0, len(run), 4096):
                    self._verify(s, n, span, hashes, run[k : k + 4096], best)
        return [(item, i, j, sim) for item, (sim, i, j) in sorted(best.items())]

    def _whole(self, s: Sized, n: int, words: int, h: np.ndarray, best: dict) -> None:
        """A text shorter than the item: all of it is the window."""
        if words < SHINGLE or len(h) < SIMILARITY * (n - SHINGLE + 1) - 1e-9:
            return
        if np.isin(h, s.known).sum() < (len(h) + n - SHINGLE + 1) * SIMILARITY / (1 + SIMILARITY) - 1e-9:
            return
        window = Counter(h.tolist())
        for item, counts in zip(s.ids, s.counts, strict=True):
            sim = similarity(window, counts)
            if sim >= SIMILARITY:
                best[item] = (sim, 0, words)

    def _verify(self, s: Sized, n: int, span: int, h: np.ndarray, at: np.ndarray, best: dict) -> None:
        low = int(at[0])
        ones = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(bits_of(np.ascontiguousarray(h[low : int(at[-1]) + span])), 0, dtype=np.int64)])
        fps = simhash(ones[at - low + span] - ones[at - low], np.full(len(at), span))
        for start, fp in zip(at.tolist(), fps, strict=True):
            near = s.near(fp)
            if not near:
                continue
            window = Counter(h[start : start + span].tolist())
            for k in near:
                sim = similarity(window, s.counts[k])
                if sim >= SIMILARITY and (s.ids[k] not in best or sim > best[s.ids[k]][0]):
                    best[s.ids[k]] = (sim, start, start + n)


def portions(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in portions of bounded size, streamed through the driver."""
    held, words = [], 0
    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():
        held.append((r.item_id, r.text))
        words += len(r.text) // 4
        if words >= ITEM_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, similarity): a row for each document and item that it holds."""
    ship(spark)
    schema = "doc_id long, item_id long, start_word long, end_word long, similarity double"
    out = None
    for portion in portions(items):
        shared = spark.sparkContext.broadcast(portion)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for b in (b for whole in batches for b in slices(whole, "_t")):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[k], *hit) for k, hits in index.search([t or b"" for t in b.column("_t").to_pylist()]) for hit in hits]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((*[pa.int64()] * 4, pa.float64()))], names=["doc_id", "item_id", "start_word", "end_word", "similarity"])

        part = docs.select("doc_id", F.col("text").cast("binary").alias("_t")).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no item.

    A verdict for each row, not a join on ids: rows without a doc_id and repeated ids are judged each on its own text.
    """
    ship(spark)
    own = spare(docs, "_t")
    for portion in portions(items):
        shared = spark.sparkContext.broadcast(portion)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for b in (b for whole in batches for b in slices(whole, own)):
                free = np.ones(b.num_rows, bool)
                free[[k for k, _ in index.search([t or b"" for t in b.column(own).to_pylist()])]] = False
                yield b.drop_columns([own]).filter(pa.array(free))

        docs = docs.withColumn(own, F.col("text").cast("binary")).mapInArrow(run, docs.schema)
    return docs


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text"), clip_columns(table(spark, sf_dir, "benchmark"), "item_id", "text"))
