"""Spans in texts: (kind, start, end) in code points, end exclusive; how they are written, merged and redacted."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare

Span = tuple[str, int, int]


def written(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end, by start, then by kind in the given order, then by end."""
    return ",".join(f"{k}:{i}:{j}" for k, i, j in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


class Taken:
    """Disjoint intervals in order, asked and added to in logarithmic time."""

    def __init__(self, held: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for i, j in sorted((i, j) for _, i, j in held):
            if self.ends and i < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], j)
            else:
                self.starts.append(i)
                self.ends.append(j)

    def free(self, i: int, j: int) -> bool:
        k = bisect_right(self.ends, i)
        return k == len(self.starts) or j <= self.starts[k]

    def add(self, i: int, j: int) -> None:
        """A free interval."""
        k = bisect_right(self.ends, i)
        self.starts.insert(k, i)
        self.ends.insert(k, j)


def free_of(added: list[tuple[float, Span]], held: list[Span]) -> list[Span]:
    """Of scored spans, those that overlap neither a held one nor a better one."""
    taken, out = Taken(held), []
    for _, (kind, i, j) in sorted(added, key=lambda s: (-s[0], s[1][1], s[1][0])):
        if taken.free(i, j):
            taken.add(i, j)
            out.append((kind, i, j))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind in capitals and brackets."""
    out, at = [], 0
    for kind, i, j in sorted(spans, key=lambda s: (s[1], -s[2])):
        if i >= at:
            out += [text[at:i], f"[{kind.upper()}]"]
        at = max(at, j)
    return "".join([*out, text[at:]])


def found_in(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], kinds: tuple[str, ...], text: str = "text", out: str = "_found") -> DataFrame:
    """Adds ``out``: counts of base spans by kind, the digest of base spans, all spans, and the redacted text if any span was found."""
    own = spare(docs, "_t")
    counted = kinds[: len(kinds) - (kinds[-1] == "random")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(own).to_pylist():
                base, added = find(t or "")
                every = base + added
                rows.append({f"n_{k}": sum(x[0] == k for x in base) for k in counted} | {"base_sha256": hashlib.sha256(written(base, kinds).encode()).hexdigest(), "spans": written(every, kinds), "clean": redacted(t, every) if every else None})
            names = [n for n in b.schema.names if n != own]
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(rows, shape)], names=[*names, out])

    shape = pa.struct([*((f"n_{k}", pa.int64()) for k in counted), ("base_sha256", pa.string()), ("spans", pa.string()), ("clean", pa.string())])
    inner = ", ".join([*(f"n_{k}: bigint" for k in counted), "base_sha256: string", "spans: string", "clean: string"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` struct<{inner}>"])
    return docs.withColumn(own, F.col(text)).mapInArrow(run, schema)
