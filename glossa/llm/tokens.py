"""Token ids as Parquet list columns.

File format: one row for each document in ascending doc_id order; ``tokens`` is a list of 32-bit ids, dictionary-encoded
(the vocabulary fits a dictionary page, so an id takes as many bits as the vocabulary needs); ``doc_id``, ``shard``,
``local_start`` and ``n_tokens`` use version-2 pages, where integers beyond the dictionary are delta-packed. Row groups
and pages are small enough that the column and page indexes which the writer adds let a reader fetch the ids of a few
documents, or the metadata without any ids. ``local_start`` counts ids within the shard, so the place of a document in
the whole stream is one bounded table of shard totals away.

Defined cases: null and empty texts hold the end id alone; repeated doc_ids keep all rows, in order of the hash of their
text and of the text; a null doc_id sorts first; texts of any length are encoded whole; an empty table writes no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import clip_columns, offsets, shared_dir, slices, table

END_ID = 2
#: Text bytes that are encoded together.
SLICE_BYTES = 4 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Pieces that a process keeps encoded, in each of two generations.
CACHED_PIECES = 150_000
_LOADED: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """A mapping of bounded size that keeps what was used lately: two generations, the older dropped whole."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def turn(self) -> None:
        """To be called between uses of ``young``."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


#: Classes of bytes: white space, letters, digits, punctuation, and those that send their word to the library whole:
#: "<" may open a special token, the apostrophe may open a contraction, and control and most non-ASCII bytes need the
#: library's own rules of form and case.
BLANK, LETTER, NUMBER, MARK, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[33:127] = MARK
CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
CLASS[48:58] = NUMBER
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[[ord("<"), ord("'")]] = OTHER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class WordEncoder:
    """A byte-level tokenizer with word ends, over many texts at once.

    Its pre-tokens never cross white space, so texts are cut into pieces by classes of bytes: runs of letters, single
    digits, runs of punctuation. Words with other bytes stay whole. Each distinct piece is encoded once, by the library,
    and kept for a while; the ids of the texts are gathered from the distinct pieces' ids.
    """

    PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
    SIMPLE = bytes(b for b in range(33, 127) if b not in b"<'")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Recent(CACHED_PIECES)
        self.model = self.tokenizer.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.visible = {b: 256 + k for k, b in enumerate(hidden)}  # the byte-level alphabet

    def _piece(self, p: bytes) -> array:
        """Packed: a list of numbers takes several times the space."""
        return array("i", self._ids(p))

    def _ids(self, p: bytes) -> list[int]:
        if not p.translate(None, self.SIMPLE):
            return [t.id for t in self.model.tokenize(p.decode("ascii"))]
        if self.PLAIN.fullmatch(p):
            return [t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.visible))]
        return self.tokenizer.encode(p.decode(), add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        first_byte = np.cumsum(size + 1) - size
        kind = CLASS[raw]
        lead = np.nonzero(raw[:-1] == 0xC3)[0]
        low = LOWER[raw]
        if len(lead):  # the Latin-1 letters
            tail = raw[lead + 1]
            good = (tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)
            lead, tail = lead[good], tail[good]
            kind[lead] = kind[lead + 1] = LETTER
            low[lead[tail < 0x9F] + 1] += 0x20
        solid = kind != BLANK
        head = np.zeros(len(raw), bool)
        head[1:] = solid[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))
        odd = kind == OTHER
        word_at = np.nonzero(solid[1:] & ~solid[:-1])[0] + 1
        word_end = np.nonzero(solid[:-1] & ~solid[1:])[0] + 1
        if odd.any():
            seen = np.concatenate([[0], np.cumsum(odd)])
            whole = np.nonzero(seen[word_end] > seen[word_at])[0]
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[word_at[whole]] += 1
            inside[word_end[whole]] -= 1
            inside = np.cumsum(inside[:-1]).astype(bool)
            low = np.where(inside, raw, low)
            head[inside] = False
            head[word_at] = True
        start = np.nonzero(head)[0]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        end = np.append(start[1:], 0)
        end[np.searchsorted(start, word_at[1:]) - 1] = word_end[:-1]
        end[-1] = word_end[-1]
        ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(low[solid].tobytes())]).dictionary_encode()
        self.known.turn()
        young, old, ids = self.known.young, self.known.old, []
        for p in pieces.dictionary.to_pylist():
            x = young.get(p)
            if x is None:
                x = young[p] = old.get(p) or self._piece(p)
            ids.append(x)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, base = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), np.cumsum(n) - n
        at = np.asarray(pieces.indices)
        count = n[at]
        after = np.cumsum(count)
        out = flat[np.repeat(base[at] - (after - count), count) + np.arange(after[-1])]
        cut = np.searchsorted(start, first_byte)  # the first piece of each text
        cut = np.append(np.concatenate([[0], after])[cut], after[-1])
        return out, np.diff(cut)


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode the texts and write them to ``path`` in the format above."""
    ship(spark)
    tokenizer = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, start, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for whole in batches:
            for b in slices(whole, "t", SLICE_BYTES):
                ids, n = enc.encode([t or b"" for t in b.column("t").to_pylist()])
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                ends = np.cumsum(n)
                yield pa.record_batch(
                    [b.column("doc_id").cast(pa.int64()), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + ends - n), pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "shard", "local_start", "n_tokens", "tokens"],
                )
                start += int(ends[-1])

    # rows that share a doc_id are dealt out by their hash, so any number of them is spread over the tasks
    order = [F.col("doc_id"), F.xxhash64("t"), F.col("t")]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("t")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    # packed ids hardly shrink further: the light codec is enough
    rows.mapInArrow(run, "doc_id long, shard int, local_start long, n_tokens long, tokens array<int>").write.options(
        **{"compression": "snappy", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.dictionary.page.size": 1 << 20, "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0"}
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """(doc_id, start, n_tokens) and the asked columns; ids are read only if asked for."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).toPandas()
    base = spark.createDataFrame([(int(k), int(v)) for k, v in offsets(totals, "shard", "n").items()], "shard int, base long")
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def ids_crc32(df: DataFrame, tokens: str = "tokens", out: str = "ids_crc32") -> DataFrame:
    """Replaces a list of ids by the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    names = [c for c in df.columns if c != tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(tokens)
            ends, ids = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(crc, pa.int64())], names=[*names, out])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), f"{out} long"])
    return df.mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark, clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text"), path)
    return ids_crc32(read_tokens(spark, path))
