"""Tagged token sequences: prediction history, feature vocabulary, examples, greedy decoding, chunks and their scores."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import count as counting
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship, written
from .selection import pos_filter
from .templates import Contexts, contexts
from .vocab import dense_ids

CAPACITY = 1000
OUTSIDE, UNKNOWN = "O", "Unk"


def corpus_order(tokens: DataFrame) -> DataFrame:
    """Adds _events, how many tagged entities come before the token in the whole corpus.

    Two levels: counts by document, running over documents, and running within the document.
    """
    event = (~F.col("tag").isin(OUTSIDE, UNKNOWN)).cast("long")
    per = tokens.groupBy("doc_id").agg(F.sum(event).alias("_n"))
    # documents by ranges of ids, so that no task sees all of them; ranges are as many as partitions
    placed = written(tokens.sparkSession, per.repartitionByRange("doc_id").withColumn("_p", F.shiftright(F.monotonically_increasing_id(), 33)), "events")
    base, rows = 0, []
    for r in placed.groupBy("_p").agg(F.sum("_n").alias("n"), F.min("doc_id").alias("low")).orderBy("low").collect():
        rows.append((r["_p"], base))
        base += r.n
    starts = F.broadcast(tokens.sparkSession.createDataFrame(rows, "_p long, _base long"))
    within = F.coalesce(F.sum("_n").over(W.partitionBy("_p").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = placed.join(starts, "_p").select("doc_id", (F.col("_base") + within).alias("_before"))
    own = F.coalesce(F.sum(event).over(W.partitionBy("doc_id").orderBy("sent_id", "tok_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return tokens.withColumn("_own", own).join(before, "doc_id").withColumn("_events", F.col("_before") + F.col("_own")).drop("_own", "_before")


#: So many entities of the corpus make a range; a frequent word is dealt out by ranges.
RANGE = 1_000_000


def extended_history(tokens: DataFrame, tags: list[str], capacity: int = CAPACITY, range_: int = RANGE) -> DataFrame:
    """Adds eph_<tag>: how often the word had the tag among the last ``capacity`` entities before the token; 0 for tags of no entity.

    The frame never reaches back further than ``capacity`` entities, so a range of the corpus needs no more of the range
    before than its last entities; with these repeated, a word is one partition for each range, not one for all.
    """
    entity = ~F.col("tag").isin(OUTSIDE, UNKNOWN)
    ordered = corpus_order(tokens).withColumn("_range", F.floor(F.col("_events") / range_)).withColumn("_again", F.lit(False))
    again = ordered.where(entity & (F.col("_events") % range_ >= range_ - capacity)).withColumn("_range", F.col("_range") + 1).withColumn("_again", F.lit(True))
    w = W.partitionBy("word", "_range").orderBy("_events").rangeBetween(-capacity, -1)
    count = lambda t: F.coalesce(F.sum(F.when((F.col("tag") == t) & entity, 1)).over(w), F.lit(0)).cast("long")
    return ordered.unionByName(again).withColumns({f"eph_{t}": count(t) for t in tags}).where("not _again").drop("_events", "_range", "_again")


def history_distribution(tokens: DataFrame, tags: list[str]) -> DataFrame:
    """The history counts as shares; null without history."""
    total = sum((F.col(f"eph_{t}") for t in tags), F.lit(0))
    return tokens.withColumns({f"eph_{t}": F.when(total > 0, F.col(f"eph_{t}") / total) for t in tags})


class History:
    """The same history, fed token by token."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.events, self.counts = capacity, deque(), {}

    def push(self, word: str, tag: str) -> None:
        if tag in (OUTSIDE, UNKNOWN):
            return
        if len(self.events) == self.capacity:
            w, t = self.events.popleft()
            self.counts[w][t] -= 1
            if not any(self.counts[w].values()):
                del self.counts[w]
        self.events.append((word, tag))
        self.counts.setdefault(word, Counter())[tag] += 1

    def get(self, word: str) -> dict[str, int]:
        return {t: n for t, n in self.counts.get(word, {}).items() if n}


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fname", F.concat("ftype", F.lit("="), "fval"))


def feature_vocabulary(readers: list[tuple[DataFrame, int]], detector: str, lexicons: dict[str, DataFrame] | None = None, tags: list[str] | None = None, use_eph: bool = False, pos_prefixes: tuple[str, ...] = (), wanted: Callable[[str], bool] | None = None, counts: bool = False) -> DataFrame:
    """(fname, fid): the features with at least the reader's least count, in any reader; ids by name.

    pos_prefixes: only tokens whose part of speech starts so are counted (their neighbours are seen all the same). wanted:
    only features of these names. counts: also n, over the readers in which the feature is frequent enough.
    """
    names = None
    for tokens, least in readers:
        only = (lambda t: pos_filter(t, list(pos_prefixes), "`@cur`.pos")) if pos_prefixes else None
        found = contexts(tokens, detector, lexicons, wanted=wanted, gold="tag" in tokens.columns and bool(tags), only=only).counts()
        part = named(found).groupBy("fname").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        names = part if names is None else names.union(part)
    if use_eph and tags:
        names = names.union(readers[0][0].sparkSession.createDataFrame([(f"eph={t}", 0) for t in tags], "fname string, n long"))
    voc = dense_ids(names.groupBy("fname").agg(F.sum("n").alias("n")), "fname", "fid")
    return voc if counts else voc.drop("n")


#: The word templates of the subspace set by bit: of one word (the last two places are two words away), and of two.
WORD_TEMPLATES = ("uword_cur", "uword_pre", "uword_2pre", "uword_post", "uword_2post", "bword_pre_cur", "bword_cur_post")


def word_vocabulary(lines: DataFrame, least: int = 1) -> DataFrame:
    """(fname, n, fid): what ``feature_vocabulary`` finds for the word templates of rr09_aso. lines: (ws), the words of a sentence.

    A word is the current one once, and the one before, after, ... of its neighbours, so it leaves its sentence once, with
    a mask of the templates that it counts for; so does a pair, which is (before, current) and (current, after). Only
    words, and pairs that may lie at an edge of a sentence, have several masks to be added up; other pairs are whole
    after their count, and rare ones end there.
    """
    a = lines.where(F.size("ws") > 0).select(F.transform("ws", lambda w: F.when(w.rlike("[0-9]"), T.numify(w)).otherwise(w)).alias("a"), F.size("ws").alias("n"))
    bit = lambda i, test: F.when(test, F.lit(1 << i)).otherwise(F.lit(0))
    row = lambda v, mask: F.struct(v.alias("fval"), mask.cast("int").alias("mask"))
    n = F.col("n")
    words = F.transform("a", lambda w, j: row(w, 1 + bit(1, j < n - 1) + bit(2, j < n - 2) + bit(3, j > 0) + bit(4, j > 1)))
    pairs = F.transform(F.slice("a", 1, n - 1), lambda w, j: row(T.joined(w, F.get("a", j + 1)), F.lit(3 << 5)))
    edges = [row(F.lit(T.START), F.lit(1 << 1 | 1 << 2)), row(F.lit(T.END), F.lit(1 << 3 | 1 << 4)), row(T.joined(F.lit(T.START), F.get("a", F.lit(0))), F.lit(1 << 5)), row(T.joined(F.element_at("a", -1), F.lit(T.END)), F.lit(1 << 6))]
    # with a second word, what is two words away lies beyond the edge once more
    edges = F.concat(F.array(*edges), F.when(n > 1, F.array(row(F.lit(T.START), F.lit(1 << 2)), row(F.lit(T.END), F.lit(1 << 4)))).otherwise(F.array().cast("array<struct<fval:string,mask:int>>")))
    counted = written(lines.sparkSession, a.select(F.inline(F.concat(words, pairs, edges))).groupBy("fval", "mask").agg(F.count(F.lit(1)).alias("n")).where(~whole_pair() | (F.col("n") >= least)), "counted")
    each = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(t)) for i, t in enumerate(WORD_TEMPLATES)]), lambda t: t.isNotNull())
    named_ = lambda df: df.select(F.explode(each).alias("ftype"), "fval", "n").select(F.concat("ftype", F.lit("="), "fval").alias("fname"), "n")
    several = named_(counted.where(~whole_pair())).groupBy("fname").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return dense_ids(named_(counted.where(whole_pair())).unionByName(several), "fname", "fid")


def whole_pair() -> Column:
    """Whether a row of counted words and pairs is a pair that no other row adds to."""
    return (F.col("mask") == 3 << 5) & ~F.col("fval").startswith(f"{T.START}/") & ~F.col("fval").endswith(f"/{T.END}")


def known(found: Contexts, vocab: DataFrame) -> DataFrame:
    """(keys, tok_idx, fid): the features of the vocabulary (fname, fid) that tokens have. Names are looked up once for each distinct context."""
    voc = vocab.select("fname", "fid")
    rows = [found.looked_up(g, found.tokens, voc, F.collect_list("fid").alias("found")).select(*found.ids, F.explode("found").alias("fid")) for g in found.groups]
    if found.bags is not None:
        rows.append(named(found.bags).join(voc, "fname").select(*found.ids, "fid"))
    return reduce(DataFrame.unionByName, rows)


def examples(tokens: DataFrame, detector: str, vocab: DataFrame, tags: list[str], lexicons: dict[str, DataFrame] | None = None, use_eph: bool = False, gold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(features, labels): (doc_id, sent_id, tok_idx, fid, val) and (doc_id, sent_id, tok_idx, y); unlabelled tokens have y = -1."""
    ids = ["doc_id", "sent_id", "tok_idx"]
    rows = known(contexts(tokens, detector, lexicons, gold=gold), vocab).withColumn("val", F.lit(1.0))
    if use_eph and gold:
        eph = extended_history(tokens, tags)
        each = F.array(*[F.struct(F.lit(f"eph={t}").alias("fname"), F.col(f"eph_{t}").cast("double").alias("val")) for t in tags])
        rows = rows.unionByName(eph.select(*ids, F.inline(F.filter(each, lambda x: x["val"] > 0))).join(F.broadcast(vocab.where(F.col("fname").startswith("eph=")).select("fname", "fid")), "fname").select(*ids, "fid", "val"))
    number = F.coalesce(*[F.when(F.col("tag") == t, F.lit(i)) for i, t in enumerate(tags)], F.lit(-1))
    return rows, tokens.select(*ids, number.alias("y"))


#: So many tokens make a range that one task decodes from an assumed history.
DECODED = 200_000
EVENTS = "array<struct<word:string,tag:string>>"
ARROW_EVENTS = pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())]))
#: A range that gets another history is first decoded again up to so many times ``capacity`` entities.
HEAD = 3
IDS = ["doc_id", "sent_id", "tok_idx"]
#: So many decisions, and scores of features, are remembered at a time.
REMEMBERED = 200_000


def _number(s: str) -> str:
    return s if sum(not "0" <= c <= "9" for c in s) > 2 else "".join("*d*" if "0" <= c <= "9" else c for c in s)


class Decoder:
    """Greedy tags of one sentence after the other. What doesn't hang on the words around is decided once and remembered."""

    def __init__(self, model: dict[str, list[tuple[int, float]]], tags: list[str], detector: str, use_eph: bool, capacity: int, before: Iterable[tuple[str, str]] = ()) -> None:
        old = detector in ("zj03", "az05")
        self.model, self.tags, self.use_eph, self.seen = model, tags, use_eph, History(capacity)
        for w, t in before:
            self.seen.push(w, t)
        if old:
            self.one, self.two, self.bigram, around = "pre_tag=", "pre_pre_tag=", "tag_bigram=", {"pre_tag_w=": 0}
        else:
            unigram, word, self.bigram = ("utag_", "btagw_pre_", "btagw_2pre_pre=") if detector == "rr09_aso" else ("tag_tag_", "tag_pretagword_", "tag_bigram_2pre_pre=")
            self.one, self.two = f"{unigram}pre=", f"{unigram}2pre="
            around = {f"{word}{p}=": k for p, k in (("cur", 0), ("pre", -1), ("2pre", -2), ("post", 1), ("2post", 2))}
        # families of names that the model doesn't have at all are never built
        self.around = [(n, k) for n, k in around.items() if any(x.startswith(n) for x in model)]
        self.kept = (lambda w: w) if old else _number
        self.fixed: dict[tuple, list[float]] = {}
        self.known: dict[tuple, int] = {}

    def _fixed(self, names: tuple, vals: tuple) -> list[float]:
        score = [0.0] * len(self.tags)
        for f, x in zip(names, vals, strict=True):
            for c, w in self.model.get(f, ()):
                score[c] += w * x
        return score

    def _best(self, fixed: list[float], one: str, two: str, beside: list, past: tuple) -> int:
        score, get = list(fixed), self.model.get
        for c, w in (*get(self.one + one, ()), *get(self.two + two, ()), *beside, *get(f"{self.bigram}{two}/{one}", ())):
            score[c] += w
        for t, n in past:
            for c, w in get(f"eph={t}", ()):
                score[c] += w * n
        return max(range(len(score)), key=lambda c: (score[c], c))  # of equals the last

    def tag(self, words: list[str], names: list[tuple], vals: list[tuple]) -> list[str]:
        given, counts, push = [], self.seen.counts, self.seen.push
        one = two = T.START
        for k, w in enumerate(words):
            own = (names[k], vals[k])
            fixed = self.fixed.get(own)
            if fixed is None:
                if len(self.fixed) >= REMEMBERED:
                    self.fixed.clear()
                fixed = self.fixed[own] = self._fixed(*own)
            beside = []
            for n, o in self.around:
                near = words[k + o] if 0 <= k + o < len(words) else T.START if k + o < 0 else T.END
                beside += self.model.get(f"{n}{one}/{self.kept(near)}", ())
            held = counts.get(w) if self.use_eph else None
            past = tuple((t, held[t]) for t in self.tags if held[t]) if held else ()
            if beside:
                best = self._best(fixed, one, two, beside, past)
            else:
                best = self.known.get(key := (own, one, two, past))
                if best is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    best = self.known[key] = self._best(fixed, one, two, [], past)
            one, two = self.tags[best], one
            given.append(one)
            push(w, one)
        return given


def _starts(table: pa.Table) -> np.ndarray:
    """Where sentences start in sorted rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("doc_id", "sent_id"):
        codes = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.nonzero(new)[0]


def _flat(column: pa.ChunkedArray) -> tuple[list, list[int]]:
    """All values of a column of lists, and where each row's start; an absent list is empty."""
    lists = column.combine_chunks()
    return lists.values.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_numpy().tolist()


def _sentences(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, int, list[str], list[tuple], list[tuple]]]:
    """(first row, row behind, words, names, values) of each sentence."""
    words = table.column("word").combine_chunks().to_numpy(zero_copy_only=False).tolist()
    (names, at), (vals, to) = (_flat(table.column(c)) for c in ("fnames", "vals"))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
        yield i, j, words[i:j], [tuple(names[at[x] : at[x + 1]]) for x in range(i, j)], [tuple(vals[to[x] : to[x + 1]]) for x in range(i, j)]


def by_ranges(spark: SparkSession, joined: DataFrame, n: int, decoder: Callable[[Iterable[tuple[str, str]]], Decoder], capacity: int) -> DataFrame:
    """The rows with pred over the whole corpus, in n ranges, each from the history that the ranges before it leave.

    All ranges are first decoded from an empty history, as they are written. A range whose assumed history isn't what the
    range before it now leaves is decoded again from that, until none is. As soon as ``capacity`` entities in a row, with
    all that lies between, have the tags that they had, the history is the one that it was, and so is all that follows;
    so a range is first decoded again over its head only, and as a whole if that isn't enough. The first n ranges are right
    after n rounds, whatever the data, and as a history reaches back only so many entities, most settle after two or three.
    Histories and changed tags stay in tables; the driver sees the numbers of the ranges.

    joined: tokens with fnames and vals.
    """
    fields = joined.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, at, run, events, rest = TaskContext.get().partitionId(), 0, decoder(()), 0, None
        names = [*fields, "_k", "_i", "_e", "pred", "_out"]

        def tagged(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal at, events
            pred, before = [], np.zeros(table.num_rows, np.int64)
            for i, j, *sentence in _sentences(table, _starts(table)):
                before[i:j] = events
                pred += (given := run.tag(*sentence))
                events += sum(t not in (OUTSIDE, UNKNOWN) for t in given)
            m = table.num_rows
            more = [pa.array(np.full(m, k)), pa.array(np.arange(at, at + m)), pa.array(before), pa.array(pred, pa.string()), pa.nulls(m, ARROW_EVENTS)]
            at += m
            yield from pa.table([*table.columns, *more], names=names).to_batches()

        for b in batches:
            table = pa.Table.from_batches([b])
            table = table if rest is None else pa.concat_tables([rest, table])
            if table.num_rows == 0:
                continue
            cut = int(_starts(table)[-1])  # the last sentence may go on
            rest = table.slice(cut)
            if cut:
                yield from tagged(table.slice(0, cut))
        if rest is not None:
            yield from tagged(rest)
            behind = pa.array([[{"word": w, "tag": t} for w, t in run.seen.events]], ARROW_EVENTS)
            last = [pa.nulls(1, f.type) for f in rest.schema]
            yield pa.record_batch([*last, pa.array([k]), pa.array([at]), pa.array([events]), pa.nulls(1, pa.string()), behind], names=names)

    sorted_ = joined.repartitionByRange(n, "doc_id", "sent_id").sortWithinPartitions(*IDS)
    placed = written(spark, sorted_.mapInArrow(first, f"{types}, _k long, _i long, _e long, pred string, _out {EVENTS}"), "ranges")
    rows = placed.where(F.col("_out").isNull()).drop("_out")
    none = F.array().cast(EVENTS)
    state = written(spark, placed.where(F.col("_out").isNotNull()).select("_k", F.col("_i").alias("_n"), none.alias("_in"), "_out", F.lit(False).alias("_wide")), "histories")
    there = sorted(r["_k"] for r in state.select("_k").collect())
    follows = spark.createDataFrame(list(zip(there, [None, *there], strict=False)), "_k long, _before long")

    def settle(own: pa.Table, given: pa.Table) -> pa.Table:
        own, given = own.sort_by("_i"), given.to_pylist()[0]
        run, was = decoder((e["word"], e["tag"]) for e in given["_in"]), own.column("pred").to_pylist()
        at, new, same = [], [], 0
        for i, j, *sentence in _sentences(own, _starts(own)):
            if same >= capacity:
                break
            for x, t in enumerate(run.tag(*sentence), i):
                if t != was[x]:
                    at.append(x)
                    new.append(t)
                    same = 0
                elif t not in (OUTSIDE, UNKNOWN):
                    same += 1
        merged, whole = same >= capacity, own.num_rows == given["_n"]
        if not merged and not whole:
            at, new = [], []
        behind = given["_out"] if merged or not whole else [{"word": w, "tag": t} for w, t in run.seen.events]
        m = len(at)
        columns = [[given["_k"]] * (m + 1), [*at, None], [*new, None], [None] * m + [behind], [None] * m + [merged or whole]]
        kinds = (pa.int64(), pa.int64(), pa.string(), ARROW_EVENTS, pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["_k", "_i", "pred", "_out", "_done"])

    fixes = None
    for round_ in counting(1):
        behind = state.select(F.col("_k").alias("_before"), F.col("_out").alias("_true"))
        now = follows.join(behind, "_before", "left").select("_k", F.coalesce("_true", none).alias("_true"))
        todo = written(spark, state.join(now, "_k").where(F.col("_in") != F.col("_true")).select("_k", "_n", F.col("_true").alias("_in"), "_out", "_wide"), "assumed")
        asked = [r["_k"] for r in todo.select("_k").collect()]
        if not asked:
            break
        # a range lies in files of its own, so those of all others are skipped
        again = rows.where(F.col("_k").isin(asked)).join(F.broadcast(todo.select("_k", "_wide")), "_k").where(F.col("_wide") | (F.col("_e") < HEAD * capacity)).drop("_wide")
        again = _corrected(again, fixes).select("_k", "_i", "doc_id", "sent_id", "word", "fnames", "vals", "pred")
        found = written(spark, again.groupBy("_k").cogroup(todo.groupBy("_k")).applyInArrow(settle, f"_k long, _i long, pred string, _out {EVENTS}, _done boolean"), "decoded")
        changed = found.where(F.col("_i").isNotNull()).select("_k", "_i", "pred", F.lit(round_).alias("_round"))
        fixes = changed if fixes is None else fixes.unionByName(changed)
        ends = found.where(F.col("_done").isNotNull()).select("_k", F.col("_out").alias("_end"), "_done")
        fresh = todo.join(ends, "_k").join(state.select("_k", F.col("_in").alias("_was")), "_k")
        fresh = fresh.select("_k", "_n", F.when(F.col("_done"), F.col("_in")).otherwise(F.col("_was")).alias("_in"), F.col("_end").alias("_out"), (F.col("_wide") | ~F.col("_done")).alias("_wide"))
        state = written(spark, fresh.unionByName(state.join(todo.select("_k"), "_k", "left_anti")), "histories")
    return _corrected(rows, fixes).select(*[c for c in fields if c not in ("fnames", "vals")], "pred")


def _corrected(rows: DataFrame, fixes: DataFrame | None) -> DataFrame:
    """The rows with the tags of the last round that changed them."""
    if fixes is None:
        return rows
    last = fixes.groupBy("_k", "_i").agg(F.max_by("pred", "_round").alias("_fix"))
    return rows.join(last, ["_k", "_i"], "left").withColumn("pred", F.coalesce("_fix", "pred")).drop("_fix")


def greedy_tags(tokens: DataFrame, rows: DataFrame, weights: dict[tuple[int, str], float], tags: list[str], detector: str, use_eph: bool = False, scope: str = "document", range_tokens: int = DECODED, capacity: int = CAPACITY) -> DataFrame:
    """Adds pred: each sentence from left to right, with the tags just given as history.

    rows: (doc_id, sent_id, tok_idx, fname, val), the features that don't depend on tags. weights: by (class, feature
    name). The extended history, of ``capacity`` entities, is kept by document, or with scope ``corpus`` by the whole
    corpus, in ranges of about range_tokens tokens (``by_ranges``); both give what one task from left to right would give.
    """
    spark = tokens.sparkSession
    ship(spark)
    feats = rows.groupBy(*IDS).agg(F.collect_list("fname").alias("fnames"), F.collect_list("val").alias("vals"))
    by_name: dict[str, list[tuple[int, float]]] = {}
    for (c, name), w in weights.items():
        by_name.setdefault(name, []).append((c, w))
    shared = spark.sparkContext.broadcast(by_name)

    def decoder(before: Iterable[tuple[str, str]] = ()) -> Decoder:
        return Decoder(shared.value, tags, detector, use_eph, capacity, before)

    joined = tokens.join(feats, IDS, "left")
    if use_eph and scope == "corpus":
        return by_ranges(spark, joined, -(-tokens.count() // range_tokens) or 1, decoder, capacity)

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, run, out = pdf.sort_values(IDS), decoder(), []
        for _, g in groupby(pdf.itertuples(index=False), key=lambda r: (r.doc_id, r.sent_id)):
            g = list(g)
            out += run.tag([r.word for r in g], *([tuple(x) if x is not None else () for x in column] for column in ((r.fnames for r in g), (r.vals for r in g))))
        return pdf[IDS].assign(pred=out)

    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    key = F.col("doc_id") if use_eph else F.xxhash64("doc_id", "sent_id") % 4096
    pred = joined.select(*IDS, "word", "fnames", "vals").groupBy(key.alias("_k")).applyInPandas(decode, f"doc_id {kinds['doc_id']}, sent_id {kinds['sent_id']}, tok_idx {kinds['tok_idx']}, pred string")
    return tokens.join(pred, IDS)


def chunks(tokens: DataFrame, tag: str = "tag", keys: tuple[str, ...] = ("doc_id", "sent_id")) -> DataFrame:
    """(keys, start, end, type, phrase): maximal runs of entity tags; B-, or another type than before, starts a new one."""
    w = W.partitionBy(*keys).orderBy("tok_idx")
    kind = F.when(F.col(tag) == OUTSIDE, None).otherwise(F.element_at(F.split(F.col(tag), "-"), -1))
    t = tokens.select(*keys, "tok_idx", "word", F.col(tag).alias("_t"), kind.alias("type"))
    t = t.withColumn("_new", (F.col("type").isNotNull() & (F.col("_t").startswith("B-") | F.lag("type").over(w).isNull() | (F.lag("type").over(w) != F.col("type")))).cast("int"))
    t = t.withColumn("_c", F.sum("_new").over(w)).where("type is not null")
    at = F.array_sort(F.collect_list(F.struct("tok_idx", "word")))
    return t.groupBy(*keys, "_c").agg(F.min("tok_idx").alias("start"), F.max("tok_idx").alias("end"), F.first("type").alias("type"), F.array_join(F.transform(at, lambda x: x["word"]), " ").alias("phrase")).drop("_c")


def chunk_scores(tokens: DataFrame, gold: str = "tag", pred: str = "pred") -> DataFrame:
    """(type, gold, found, correct, precision, recall, f1) by type and, as ALL, over all, in percent."""
    keys = ["doc_id", "sent_id", "start", "end", "type"]
    g, p = (chunks(tokens, c).select(*keys) for c in (gold, pred))
    both = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), keys, "full")
    each = both.select(F.explode(F.array(F.col("type"), F.lit("ALL"))).alias("type"), "g", "p")
    n = each.groupBy("type").agg(F.count("g").alias("gold"), F.count("p").alias("found"), F.sum((F.col("g").isNotNull() & F.col("p").isNotNull()).cast("long")).alias("correct"))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(100.0 * a / b)
    n = n.withColumn("precision", share(F.col("correct"), F.col("found"))).withColumn("recall", share(F.col("correct"), F.col("gold")))
    return n.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def accuracy(df: DataFrame, gold: str = "tag", pred: str = "pred") -> DataFrame:
    """(n, accuracy) in percent."""
    return df.agg(F.count(F.lit(1)).alias("n"), (100.0 - 100.0 * F.avg((F.col(gold) != F.col(pred)).cast("int"))).alias("accuracy"))


def entities(tokens: DataFrame, tag: str = "tag", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, start, phrase): consecutive entity words of a document; B starts a new one, whatever the type. The last one counts too."""
    order = W.partitionBy(*keys).orderBy("sent_id", "tok_idx")
    inside: Column = F.col(tag) != OUTSIDE
    t = tokens.withColumn("_n", F.row_number().over(order))
    t = t.withColumn("_new", (inside & (F.col(tag).startswith("B") | F.coalesce(F.lag(tag).over(order) == OUTSIDE, F.lit(True)))).cast("int")).withColumn("_c", F.sum("_new").over(order)).where(inside)
    return t.groupBy(*keys, "_c").agg(F.min("_n").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "word"))), lambda x: x["word"]), " ").alias("phrase")).drop("_c")
