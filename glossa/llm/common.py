"""Shared pieces of the training-data operators: storage for cut lineage, text columns, exact prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

if TYPE_CHECKING:  # workers that never see a frame needn't load the library
    import pandas as pd

#: White space between words: the six ASCII characters, nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def staged(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later stages survive lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged = path
    return back


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove the folders of staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_staged", None):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: For ``str.translate``: the same as lower_ascii, in Python.
TO_LOWER = {c: c + 32 for c in range(65, 91)}


def crc32_of_id(doc_id: Column) -> Column:
    """CRC-32 of a document id written as decimal text; null counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))


def clip_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns never clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def spare(df: DataFrame, name: str) -> str:
    """The name, longer by underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in a binary column hold about ``most`` bytes together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def picked(df: DataFrame, h: Column, most: int) -> DataFrame:
    """About ``most`` rows, the same ones each time, or all if there are no more. h: a 64-bit hash, fine enough for any number of rows."""
    n = df.count()
    return df if n <= most else df.where(F.shiftrightunsigned(h, 1) < int(most / n * (1 << 53)) << 10)


def bounded_rows(df: DataFrame, most: int) -> DataFrame | None:
    """``df`` marked for broadcast if it has at most ``most`` rows, else None. One count of a bounded prefix decides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else None


MIX = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Values by 64-bit key: open addressing with linear probes, built and asked in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, np.nan, values.dtype)
        at, left = self._at(keys), np.arange(len(keys))
        while len(left):
            free = np.isnan(self.values[at])
            who, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.keys[who], self.values[who] = keys[chosen], values[chosen]
            rest = self.keys[at] != keys[left]
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; NaN where there is none."""
        at = self._at(keys)
        out = self.values[at]
        left = np.nonzero((self.keys[at] != keys) & ~np.isnan(out))[0]
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[left] = self.values[at]
            on = (self.keys[at] != keys[left]) & ~np.isnan(out[left])
            left, at = left[on], at[on]
        return out


def offsets(totals: pd.DataFrame, key: str, value: str) -> dict[int, int]:
    """Exclusive prefix sums of per-partition totals, in the order of the key."""
    totals = totals.sort_values(key)
    return dict(zip(totals[key].tolist(), (np.cumsum(totals[value].to_numpy()) - totals[value].to_numpy()).tolist(), strict=True))
