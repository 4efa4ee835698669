"""SentencePiece encoding and decoding over a relational lattice.

A text becomes the library's form (a space in front, every space a word mark) and is cut into units: in front of every
space behind another character, and wherever two neighbouring ASCII characters stand together inside no piece. No edge
of the lattice crosses such a place, so units are encoded on their own, each distinct one once (``encode_units``): its
substrings up to the longest piece are exploded, joined to the piece table, grouped by unit, and a Viterbi fold
(``aggregate``) walks from the first character to the last with the best last piece of every prefix as its state.

The models at hand are byte-pair models, whose scores are ranks of merges, so the path of the highest sum of scores is
not the library's encoding. Its encoding has a path property of its own: a sequence of pieces is the encoding if and only
if no merge crosses the border of any two neighbours, encoded together. So an edge costs nothing or everything, by its
predecessor alone, and every prefix has exactly one best last piece, as Viterbi needs. Whether a merge crosses a border
is read off the lattice: it is an edge across the border whose left part was at some time the last segment of the left
piece, whose right part was at that time the first segment of the right one, and whose rank is better than the next
merges on both sides. When segments stand at the border of a piece, and what merges follow, is part of the piece table.

Applying the encodings: the most frequent units, up to HOT_BYTES, travel to the tasks; if they aren't all, every text asks for the
others it holds, a join answers, and the answers meet the compressed text by a hash of its row. An answer names its
unit, so rows that share a hash get too many answers, never wrong ones. Units beyond LONG characters without a blank
don't become rows of the lattice, which would have to hold them whole; the merges of the library encode them.

Defined cases: null and empty texts have no ids and decode to the empty text; the word mark in a text decodes to a space,
as in the library; texts of any length are encoded whole; repeated rows are each encoded; an empty table gives an empty
result; extra columns are kept.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import Lookup, clip_columns, discard, slices, spare, staged, table

MARK = "▁"
#: Bytes of units that travel to the tasks, with UNIT_BYTES more for each unit.
HOT_BYTES = 24 << 20
UNIT_BYTES = 24
#: Text bytes that are encoded together.
SLICE_BYTES = 2 << 20
#: Distinct units that a task counts before it hands them on.
COUNTED_UNITS = 1_500_000
#: Distinct units that one task folds.
UNITS_A_TASK = 8_000
LONG = 20_000
#: Characters that tell which lengths a piece can have.
FRONT = 4
#: Places of the parts of a packed segment: its length, when it came about, the next merge, the highest merge by then.
LENGTH, BORN, NEXT, HIGHEST = 54, 36, 18, 0
NEVER = (1 << 18) - 1
#: In a path, a character that is no piece stands as its code point beyond this number.
NO_PIECE = 1 << 30
_LOADED: dict = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The piece table of a byte-pair model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.names[i]: i for i in plain}
        # 1 for the best score; equal scores share a rank
        ranks = np.unique(np.array([-sp.get_score(i) for i in plain]), return_inverse=True)[1] + 1
        self.rank = dict(zip(self.id, ranks.tolist(), strict=True))
        self.byte = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.id))
        if len(plain) >= NEVER or self.longest >= 1 << 9:
            raise ValueError("too many or too long pieces for packed segments")
        #: What an id decodes to.
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]
        # two ASCII characters that stand together in no piece; other characters are cut off by spaces only
        joined = {a + b for p in self.id for a, b in zip(p, p[1:], strict=False)}
        cut = np.zeros((256, 256), bool)
        for a in range(128):
            for b in range(128):
                cut[a, b] = (chr(a) + chr(b)).replace(" ", MARK) not in joined
        cut[128:, 32] = not any(x[1] == MARK and ord(x[0]) > 127 and x[0] != MARK for x in joined)
        self.cut = cut.ravel()

    def merges(self, text: str) -> list[tuple[int, int, int]]:
        """(rank, length of the first segment, length of the last) after each merge of a text."""
        parts: list[str | None] = list(text)
        n, log = len(parts), []
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        agenda: list[tuple[int, int, str]] = []
        last = n - 1

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (r := self.rank.get(s := parts[i] + parts[j])) is not None:
                heapq.heappush(agenda, (r, i, s))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            r, i, s = heapq.heappop(agenda)
            if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != len(s) or parts[i] + parts[j] != s:
                continue
            parts[i], parts[j] = s, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            else:
                last = i
            log.append((r, len(parts[0]), len(parts[last])))
            offer(before[i], i)
            offer(i, after[i])
        self.parts = [p for p in parts if p is not None]
        return log

    def encode_unit(self, unit: str) -> list[int]:
        """The ids of one unit by its merges."""
        self.merges(unit)
        return list(chain.from_iterable([i] if (i := self.id.get(p)) is not None else [self.byte[b] for b in p.encode()] for p in self.parts))

    def lengths(self) -> dict[str, set[int]]:
        """By their first FRONT characters, the lengths of all pieces of so many or more, and all shorter ones."""
        found: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) >= FRONT:
                found.setdefault(p[:FRONT], set(range(1, FRONT))).add(len(p))
        return found

    def segments(self, piece: str) -> tuple[list[int], list[int]]:
        """Segments that stand at the left and the right border of a piece while it is merged, packed."""
        log = self.merges(piece)
        ranks = [r for r, *_ in log]
        highest = np.maximum.accumulate(ranks).tolist() if ranks else []
        out = []
        for side in (1, 2):
            held, size, since = [], 1, 0
            for i in range(len(log) + 1):
                # before merge i the segment has this size since merge `since`
                size, since = (log[i - 1][side], i) if i and log[i - 1][side] != size else (size, since)
                born = highest[since - 1] if since else 0
                nxt, top = (ranks[i], highest[i]) if i < len(log) else (NEVER, NEVER)
                held.append((size, born, nxt, top))
            # of the merges to come while a segment stands, one that is behind another in both respects decides nothing
            kept = [a for a in held if not any(a != b and a[:2] == b[:2] and b[2] >= a[2] and b[3] >= a[3] for b in held)]
            out.append([k << LENGTH | b << BORN | n << NEXT | h << HIGHEST for k, b, n, h in dict.fromkeys(kept)])
        return out[0], out[1]

    def table(self) -> list[tuple[str, int, int, list[int] | None, list[int] | None]]:
        """(piece, id, rank, segments at its left, at its right); a single character is the only segment of itself."""
        return [(p, i, self.rank[p], *(self.segments(p) if len(p) > 1 else (None, None))) for p, i in self.id.items()]


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def cut_units(model: Pieces, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of all texts as a dictionary array (word marks as spaces), and how many each text has."""
    texts = [b" " + t.replace(b"\xe2\x96\x81", b" ") if t else b"" for t in texts]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    head = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        head[1:-1] = model.cut[(raw[:-1].astype(np.int32) << 8) | raw[1:]]
    head[first] = True
    start = np.nonzero(head[:-1])[0]
    ends = np.append(start, len(raw)).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
    return units, np.diff(np.searchsorted(start, np.append(first, len(raw))))


def runs(base: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions base[i], base[i] + 1, ... (count[i] of them), for all i in a row."""
    after = np.cumsum(count)
    n = int(after[-1]) if len(after) else 0
    size = np.int32 if n < 1 << 31 and (not len(base) or int(base.max()) + n < 1 << 31) else np.int64  # half the memory to move
    out = np.repeat((base - (after - count)).astype(size), count)
    out += np.arange(n, dtype=size)
    return out


class Encoder:
    """Ids of texts from the hot units and those that answers name."""

    def __init__(self, model: Pieces, units: pa.Array, hashes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        self.model, self.units, self.ids = model, units, ids
        self.start, self.count = ends[:-1], np.diff(ends)
        self.places = Lookup(hashes, np.arange(len(units), dtype=np.float32 if len(units) < 1 << 24 else np.float64))

    def hot(self, units: pa.Array) -> np.ndarray:
        """Where each of the units stands among the hot ones, or -1. A hash finds the place, the bytes decide."""
        at = self.places.get(hashed(units)) if len(self.units) else np.full(len(units), np.nan)
        maybe = np.nonzero(~np.isnan(at))[0]
        out = np.full(len(units), -1, np.int64)
        same = pc.equal(units.take(pa.array(maybe)), self.units.take(pa.array(at[maybe].astype(np.int64)))).to_numpy(zero_copy_only=False).astype(bool)
        out[maybe[same]] = at[maybe[same]].astype(np.int64)
        return out

    def missing(self, units: pa.Array) -> np.ndarray:
        """Numbers of the units that aren't hot and have to be asked for."""
        return np.nonzero((self.hot(units) < 0) & ~beyond(units))[0]

    def encode(self, texts: list[bytes], answers: tuple[pa.Array, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has. answers: units, the ids of all, and where those of each end."""
        units, n = cut_units(self.model, texts)
        distinct = units.dictionary
        at = self.hot(distinct)
        hot, rest = np.nonzero(at >= 0)[0], np.nonzero(at < 0)[0]
        named, told, ends = answers
        asked = distinct.take(pa.array(rest))
        place = pc.fill_null(pc.index_in(asked, value_set=named), -1).to_numpy(zero_copy_only=False)
        given, answer = rest[place >= 0], place[place >= 0]
        long = rest[place < 0]
        merged = [self.model.encode_unit(u.decode().replace(" ", MARK)) if len(u) > LONG else None for u in distinct.take(pa.array(long)).to_pylist()]
        if any(x is None for x in merged):
            raise RuntimeError("a unit has no answer")
        count = np.zeros(len(distinct), np.int64)
        count[hot] = self.count[at[hot]]
        count[given] = np.diff(ends)[answer]
        count[long] = [len(x) for x in merged]
        base = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        flat[runs(base[hot], count[hot])] = self.ids[runs(self.start[at[hot]], count[hot])]
        flat[runs(base[given], count[given])] = told[runs(ends[answer], count[given])]
        flat[runs(base[long], count[long])] = np.fromiter(chain.from_iterable(merged), np.int32, int(count[long].sum()))
        index = np.asarray(units.indices)
        each = count[index]
        ids = flat[runs(base[index], each)]
        after = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(after[np.concatenate([[0], np.cumsum(n)])])


def hashed(units: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(u) for u in units.to_pylist()], np.uint64)


def beyond(units: pa.Array) -> np.ndarray:
    """Which units are too long for the lattice."""
    return np.greater(pc.binary_length(units).to_numpy(zero_copy_only=False), LONG)


def forget() -> None:
    """A worker outlives a job; what it has loaded for one needn't."""
    _LOADED.pop("encoder", None)
    _LOADED.pop("for", None)


def count_units(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(unit, n): the distinct units of all texts, word marks in place of spaces, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model, held, size = pieces(path), [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("unit").aggregate([("n", "sum")]).rename_columns(["unit", "n"])

        def sent(counted: pa.Table) -> Iterator[pa.RecordBatch]:
            units = pc.replace_substring(counted["unit"].cast(pa.string()), " ", MARK)
            yield from pa.table({"unit": units, "n": counted["n"]}).to_batches(1 << 16)

        for whole in batches:
            for b in slices(whole, "_t", SLICE_BYTES):
                units, _ = cut_units(model, [t or b"" for t in b.column("_t").to_pylist()])
                n = np.bincount(np.asarray(units.indices), minlength=len(units.dictionary))
                short = pa.array(~beyond(units.dictionary))
                held.append(pa.table({"unit": units.dictionary, "n": pa.array(n.astype(np.int64))}).filter(short))
                size += len(held[-1])
                if size > COUNTED_UNITS:
                    held = [summed()]
                    size = len(held[0])
                    if size > COUNTED_UNITS // 2:
                        yield from sent(held[0])
                        held, size = [], 0
        if held:
            yield from sent(summed())
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker waits for its next task; its memory needn't

    return docs.select(F.col(text).cast("binary").alias("_t")).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(spark: SparkSession, units: DataFrame, path: str) -> DataFrame:
    """(unit, n, edges): by end, the longest first; a character that is no piece has an edge without id.

    Only lengths that some piece has behind the same FRONT characters are looked up. Segments at an edge of the unit have
    no neighbour and are left out.
    """
    model = pieces(path)
    key = ("table", path)
    if key not in _LOADED:
        _LOADED[key] = model.table(), [(p, sorted(k)) for p, k in model.lengths().items()]
    table_, lengths = _LOADED[key]
    # as many rows as the vocabulary, or fewer
    names = F.broadcast(spark.createDataFrame(table_, "piece string, id int, rank int, l array<long>, r array<long>"))
    fronts = F.broadcast(spark.createDataFrame(lengths, "front string, ks array<int>"))
    starts = units.select("unit", "n", F.length("unit").alias("size"), F.explode(F.expr("sequence(0, length(unit) - 1)")).alias("s"))
    ways = starts.withColumn("front", F.expr(f"substring(unit, s + 1, {FRONT})")).join(fronts, "front", "left")
    spans = ways.select("unit", "n", "size", "s", F.explode(F.coalesce("ks", F.array(*map(F.lit, range(1, FRONT))))).alias("k")).where("k <= size - s")
    spans = spans.select("unit", "n", "size", "s", (F.col("s") + F.col("k")).alias("e"), F.expr("substring(unit, s + 1, k)").alias("piece"))
    edges = spans.join(names, "piece", "left").where("id is not null or e - s = 1")
    # the partitioning by unit serves the grouping
    each = F.struct("e", "s", "id", "rank", F.when(F.col("s") > 0, F.col("l")).alias("l"), F.when(F.col("e") < F.col("size"), F.col("r")).alias("r"))
    return edges.groupBy("unit").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(each)).alias("edges"))


def part(x: str, place: int) -> str:
    return f"(shiftright({x}, {place}) & {NEVER})"


def encode_units(spark: SparkSession, units: DataFrame, path: str) -> DataFrame:
    """(unit, n, ids) for distinct units (word marks, not spaces) and any n: the relational lattice and its Viterbi fold."""
    model = pieces(path)
    alone = f"array({1 << LENGTH | NEVER << NEXT | NEVER << HIGHEST}L)"  # the segments of a single character
    # t holds the places and ranks of the edges, first where the edges of each end start: as lambda variables they are read fastest.
    # q, an edge before d, is across the start of d; a is a segment at the end of the piece in front, b one at the start of d
    crossed = f"""
        exists(sequence(first[d.s], i - 1), q -> t.s[q] < d.s AND
            exists(coalesce(edges[last[d.s - 1]].r, {alone}), a -> shiftright(a, {LENGTH}) = d.s - t.s[q] AND {part("a", NEXT)} > t.rank[q] AND
                exists(coalesce(d.l, {alone}), b -> shiftright(b, {LENGTH}) = t.e[q] - d.s AND {part("b", NEXT)} >= t.rank[q] AND {part("a", HIGHEST)} > {part("b", BORN)} AND {part("b", HIGHEST)} >= {part("a", BORN)})))"""
    # last: the edge that is the last piece of each prefix; a prefix that has one looks at no other
    forward = f"""
        transform(array(named_struct('s', edges.s, 'e', edges.e, 'rank', edges.rank)), t ->
            transform(array(filter(sequence(0, size(t.e) - 1), i -> i = 0 OR t.e[i] <> t.e[i - 1])), first ->
                aggregate(sequence(0, size(t.e) - 1), cast(array() AS array<int>), (last, i) -> if(size(last) = t.e[i], last,
                    transform(array(edges[i]), d -> if(d.s = 0 OR first[d.s] >= i OR NOT {crossed}, concat(last, array(i)), last))[0])))[0])[0]"""
    # from the end: the place where the latest piece starts is where the one before ends
    backward = f"""
        aggregate(sequence(size(last), 1), array(size(last)), (ends, e) -> if(element_at(ends, -1) = e, concat(ends, array(edges[last[e - 1]].s)), ends),
            ends -> transform(reverse(slice(ends, 1, size(ends) - 1)), e -> coalesce(edges[last[e - 1]].id, {NO_PIECE} + ascii(substring(unit, e, 1)))))"""
    c = f"(v - {NO_PIECE})"
    tail = lambda at: f"{model.byte[0]} + 128 + (shiftright({c}, {at}) & 63)"
    # the bytes of a character that is no piece
    ids = f"""
        flatten(transform(path, v -> CASE WHEN v < {NO_PIECE} THEN array(v)
            WHEN {c} < 128 THEN array({model.byte[0]} + {c})
            WHEN {c} < 2048 THEN array({model.byte[0]} + 192 + shiftright({c}, 6), {tail(0)})
            WHEN {c} < 65536 THEN array({model.byte[0]} + 224 + shiftright({c}, 12), {tail(6)}, {tail(0)})
            ELSE array({model.byte[0]} + 240 + shiftright({c}, 18), {tail(12)}, {tail(6)}, {tail(0)}) END))"""
    solved = lattice(spark, units, path).withColumn("last", F.expr(forward)).withColumn("path", F.expr(backward))
    return solved.select("unit", "n", F.expr(ids).alias("ids"))


def folded(spark: SparkSession, coded: DataFrame, name: str) -> DataFrame:
    """What the fold gives, written. A task's units are few enough for a hash table, so it needn't fall back on sorting the edges."""
    fallback = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(fallback)
    spark.conf.set(fallback, str(2 * UNITS_A_TASK))
    try:
        return staged(spark, coded, name)
    finally:
        spark.conf.set(fallback, before)


def hot_from(units: DataFrame, most: int) -> int:
    """The least count such that all units of that count or more take at most ``most`` bytes, from a histogram of counts."""
    size = F.length(F.bin("n")) * 8 + F.call_function("shiftright", F.col("n") * 8, F.length(F.bin("n")) - 1) % 8  # eight steps for each doubling
    held, least = 0, 1 << 62
    for r in units.groupBy(size.alias("k")).agg(F.sum(F.octet_length("unit") + F.lit(UNIT_BYTES)).alias("b"), F.min("n").alias("least")).orderBy(F.desc("least")).collect():
        if held + r.b > most:
            break
        held, least = held + r.b, r.least
    return least


def packed(hot: DataFrame) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units, their ends and hashes, their ids and the ends of those, of a bounded table; the tasks pack it, so the driver holds no rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [x.encode() for x in pc.replace_substring(b.column("unit"), MARK, " ").to_pylist()]
            lists = b.column("ids")
            ends = np.asarray(lists.offsets)
            ids = np.asarray(lists.values)[ends[0] : ends[-1]]
            row = [b"".join(units), np.array([len(x) for x in units], np.int32).tobytes(), hashed(pa.array(units, pa.binary())).tobytes(), ids.astype(np.uint32).tobytes(), np.diff(ends).astype(np.int32).tobytes()]
            yield pa.record_batch([pa.array([x], pa.binary()) for x in row], names=["u", "un", "h", "i", "n"])

    got = hot.select("unit", "ids").mapInArrow(pack, "u binary, un binary, h binary, i binary, n binary").collect()
    whole = [b"".join(bytes(r[k]) for r in got) for k in range(5)]
    ends = lambda x: np.concatenate([[0], np.cumsum(np.frombuffer(x, np.int32))]).astype(np.int32)
    ids = np.frombuffer(whole[3], np.uint32)
    return whole[0], ends(whole[1]), np.frombuffer(whole[2], np.uint64), ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids, ends(whole[4])


#: An answer in bytes: how long the unit is, the unit with spaces for word marks, its ids.
ID = np.dtype("<u4")
SHORT_ID = np.dtype("<u2")


def id_type(model: Pieces) -> np.dtype:
    return SHORT_ID if len(model.names) <= 1 << 16 else ID


def as_bytes(units: pa.Array, lists: pa.ListArray, kind: np.dtype) -> pa.Array:
    """Each unit with its ids as one value, so that little more than these travels."""
    units = pc.replace_substring(units, MARK, " ").cast(pa.binary())
    size = pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.asarray(lists.offsets).astype(np.int64)
    ids = np.asarray(lists.values)[ends[0] : ends[-1]].astype(kind).view(np.uint8)
    count = np.diff(ends) * kind.itemsize
    after = np.concatenate([[0], np.cumsum(2 + size + count)])
    at, out = after[:-1], np.zeros(after[-1], np.uint8)
    out[at], out[at + 1] = size & 255, size >> 8
    out[runs(at + 2, size)] = np.frombuffer(b"".join(units.to_pylist()), np.uint8)
    out[runs(at + 2 + size, count)] = ids
    return pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(after.astype(np.int32)), pa.py_buffer(out)])


def answered(found: pa.ListArray, kind: np.dtype) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The answers of all rows together: units, the ids of all, and where those of each end."""
    every = found.flatten()
    if not len(every):
        return pa.array([], pa.binary()), np.zeros(0, kind), np.zeros(1, np.int64)
    ends = np.frombuffer(every.buffers()[1], np.int32)[every.offset : every.offset + len(every) + 1].astype(np.int64)
    raw = np.frombuffer(every.buffers()[2], np.uint8)
    at = ends[:-1]
    size = raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8
    count = np.diff(ends) - size - 2
    cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(every), [None, pa.py_buffer(cut), pa.py_buffer(raw[runs(at + 2, size)])])
    return units, raw[runs(at + 2 + size, count)].view(kind), np.concatenate([[0], np.cumsum(count // kind.itemsize)])


NO_ANSWERS = (pa.array([], pa.binary()), np.zeros(0, SHORT_ID), np.zeros(1, np.int64))


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids", back: str | None = None, hot_bytes: int = HOT_BYTES, digest: bool = False) -> DataFrame:
    """Adds the ids of a text column to all columns of ``docs``; with ``back`` also the text decoded from them, in the same pass.

    digest: (n_tokens, ids_crc32, decoded_crc32, exact) in place of text and ids, which then never leave the pass; exact
    tells whether the decoded text is the text.
    """
    ship(spark)
    path = path or model_path()
    units = staged(spark, count_units(docs, path, text), "units")
    least = hot_from(units, hot_bytes)
    tasks = lambda df: max(1, -(-df.count() // UNITS_A_TASK))
    known, unknown = units.where(F.col("n") >= least), units.where(F.col("n") < least)
    hot = folded(spark, encode_units(spark, known.repartition(tasks(known), "unit"), path), "hot")
    shared = spark.sparkContext.broadcast(packed(hot))
    discard(spark, hot)

    def encoder() -> Encoder:
        if _LOADED.get("for") is not shared.value:
            forget()  # before the next one is built beside it
            raw, ends, hashes, ids, id_ends = shared.value
            hot = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            _LOADED.update({"for": shared.value, "encoder": Encoder(pieces(path), hot, hashes, ids, id_ends)})
        return _LOADED["encoder"]

    kind = id_type(pieces(path))
    own, key, found = spare(docs, "_t"), spare(docs, "_key"), spare(docs, "_found")
    kept = [c for c in docs.columns if c != text]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for whole in batches:
            for b in slices(whole, own, SLICE_BYTES // 2 if rare else SLICE_BYTES):
                texts = b.column(own).to_pylist()
                if rare:
                    texts = [t and zstandard.decompress(t) for t in texts]
                answers = answered(b.column(found), kind) if rare else NO_ANSWERS
                ids, count = enc.encode([t or b"" for t in texts], answers)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                if digest:
                    made = digests(enc.model, texts, ids, ends)
                else:
                    made = {text: pa.array(texts, pa.binary()).cast(text_type), out: pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))}
                if back:
                    made[back] = pa.array([t.decode(errors="replace") for t in decoded(enc.model, ids, ends)])
                yield pa.record_batch([made[c] if c in made else b.column(c) for c in names], names=names)

    text_type = pa.binary() if docs.schema[text].dataType.typeName() == "binary" else pa.string()
    fields = [f for f in docs.schema if not digest or f.name != text]
    more = DIGEST if digest else {out: "array<int>"}
    more = more | ({back: "string"} if back else {})
    names = [*(f.name for f in fields), *more]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{n}` {t}" for n, t in more.items())])
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("binary").alias(own))
    rare = not unknown.isEmpty()
    if not rare:
        return rows.mapInArrow(finish, schema)
    rows = rows.withColumn(key, F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString())))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for whole in batches:
            for b in slices(whole, own, SLICE_BYTES):
                units, n = cut_units(enc.model, [t or b"" for t in b.column(own).to_pylist()])
                gone = np.zeros(len(units.dictionary), bool)
                gone[enc.missing(units.dictionary)] = True
                at = np.nonzero(gone[np.asarray(units.indices)])[0]
                once = np.unique(np.searchsorted(np.cumsum(n), at, "right") * len(units.dictionary) + np.asarray(units.indices)[at])
                who, which = once // max(len(units.dictionary), 1), once % max(len(units.dictionary), 1)
                asked = pc.replace_substring(units.dictionary.take(pa.array(which)).cast(pa.string()), " ", MARK)
                yield pa.record_batch([b.column(key).take(pa.array(who)), asked], names=["key", "unit"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeezer = zstandard.ZstdCompressor(level=4)
        for whole in batches:
            for b in slices(whole, own, SLICE_BYTES):
                small = pa.array([t and squeezer.compress(t) for t in b.column(own).to_pylist()], pa.binary())
                yield b.set_column(b.schema.names.index(own), own, small)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("key"), as_bytes(b.column("unit"), b.column("ids"), kind)], names=["key", "answer"])

    # both sides are dealt by unit in the same way, so the fold's result meets the asking rows where it is
    n = tasks(unknown)
    asked = rows.select(own, key).mapInArrow(ask, "key long, unit string").repartition(n, "unit")
    coded = encode_units(spark, unknown.repartition(n, "unit"), path).select("unit", "ids")
    # a task holds UNITS_A_TASK units at most, so they can be a hash table, whatever asks for them
    answers = folded(spark, asked.join(coded.hint("shuffle_hash"), "unit").select("key", "unit", "ids"), "answers")
    discard(spark, units)
    answers = answers.mapInArrow(pack, "key long, answer binary").groupBy("key").agg(F.collect_list("answer").alias(found)).withColumnRenamed("key", key)
    return rows.mapInArrow(squeeze, rows.schema).join(answers, key, "left").mapInArrow(finish, schema)


def decoded(model: Pieces, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The texts of runs of ids."""
    if "bytes" not in model.__dict__.get("_flat", {}):
        size = np.array([len(x) for x in model.bytes], np.int64)
        model._flat = {"bytes": np.frombuffer(b"".join(model.bytes), np.uint8), "start": np.cumsum(size) - size, "size": size}
    flat = model._flat
    count = flat["size"][ids]
    whole = flat["bytes"][runs(flat["start"][ids], count)].tobytes()
    cut = np.concatenate([[0], np.cumsum(count)])[ends]
    return [whole[i + 1 if whole[i : i + 1] == b" " else i : j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def decode(spark: SparkSession, df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids to all columns of ``df``; bytes that form no character become U+FFFD."""
    ship(spark)
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                lists = b.column(ids)
                ends = np.asarray(lists.offsets)
                texts = decoded(model, np.asarray(lists.values)[ends[0] : ends[-1]], ends - ends[0])
                yield pa.record_batch([*b.columns, pa.array([t.decode(errors="replace") for t in texts])], names=[*b.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` string"])
    return df.mapInArrow(run, schema)


DIGEST = {"n_tokens": "long", "ids_crc32": "long", "decoded_crc32": "long", "exact": "boolean"}


def digests(model: Pieces, texts: list[bytes | None], ids: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
    back = decoded(model, ids, ends)
    plain = ids.astype("<u4")
    crc = [zlib.crc32(plain[i:j].tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    exact = [(t or b"").replace(MARK.encode(), b" ") == d for t, d in zip(texts, back, strict=True)]
    return {"n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()), "decoded_crc32": pa.array([zlib.crc32(t) for t in back], pa.int64()), "exact": pa.array(exact)}


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text"), digest=True)
