"""The extended prediction history on a stream: counts of tags among the last entities, kept in the state store."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


OUTSIDE = ("O", "Unk")


def running_history(stream: DataFrame, capacity: int = 1000, key: str = "word", tag: str = "tag", at: str = "at", outside: tuple[str, ...] = OUTSIDE, scope: str = "key") -> DataFrame:
    """(key, at, tag, seen): before each event, how often each tag occurred for the key.

    scope ``key`` looks at the key's own last ``capacity`` entities, in parallel; ``corpus`` at those of the key among the
    last ``capacity`` entities of all keys, which is one sequence and so one state. Events whose tag is ``outside`` are no
    entities. Works on streams and on tables alike; events of one batch are taken in the order of ``at``.
    """

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, tags = (x.split("\x1f") if x else [] for x in (state.get if state.exists else ("", "")))
        rows = pd.concat(list(batches)).sort_values([at, tag], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            k, t = getattr(r, key), getattr(r, tag)
            counts = Counter(x for y, x in zip(keys, tags, strict=True) if y == str(k))
            out.append((k, getattr(r, at), t, ",".join(f"{x}:{n}" for x, n in sorted(counts.items()))))
            if t not in outside:
                keys, tags = [*keys, str(k)][-capacity:], [*tags, t][-capacity:]
        state.update(("\x1f".join(keys), "\x1f".join(tags)))
        yield pd.DataFrame(out, columns=[key, at, tag, "seen"])

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}
    by = F.col(key) if scope == "key" else F.lit(0)
    return stream.withColumn("_scope", by).groupBy("_scope").applyInPandasWithState(update, f"{key} {kind[key]}, {at} {kind[at]}, {tag} string, seen string", "keys string, tags string", "append", GroupStateTimeout.NoTimeout)
