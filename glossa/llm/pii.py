"""Personal data: fixed patterns, and boosted trees over candidate spans.

High-recall generators propose overlapping spans: everything that could be an address with its sign or dot spelled out,
and every run of digits and separators with its sub-runs of whole groups, once for each kind. Features describe the form (digits, groups, separators,
check digit, what touches the span) and the context (words nearby that announce a kind). No text of this kind comes
with labels, so the trees learn from the corpus: spans of the fixed patterns are positives, each also in rewritten forms
(sign spelled out, country code without plus, other separators) in its own place, and candidates that no fixed pattern
supports are negatives, with dates, times, prices, versions and numbers put in the same places. For each kind the
threshold is the lowest at which held-out rows reach PRECISION; without it the kind adds nothing. Added spans never
overlap those of the fixed patterns, which always stay.

The model is fitted on all candidates of all documents. Equal vectors are one row with their numbers; cuts are exact
quantiles, in which each kind and label weighs the same; every level of a tree is one pass over the rows, which stay on
the executors (``boosting.boost_rows``). Thresholds come from counts of all held-out rows by steps of log-odds.

Defined cases: null and empty texts hold no spans; texts of any length are searched whole, in time that grows
with them; a corpus without any fixed-pattern span gets no added spans; repeated
rows are each searched; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .boosting import BINS, Boosted, boost_rows, codes, stepped
from .common import clip_columns, discard, staged, table
from .spans import Span, Taken, found_in, free_of

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
#: Steps of a unit of log-odds that thresholds are made of.
STEPS = 256
#: Distinct examples that a task holds before it hands their numbers on.
COUNTED = 20_000
LEAST_POSITIVES = 20
#: Examples of one text leave the worker in portions of so many.
PORTION = 10_000

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?: ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot )[A-Za-z0-9-]{1,63})+| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63})+)"
)
DIGITS = re.compile(r"[+(]?[0-9](?:[ ().\-/\[\]]{0,3}[0-9])+")
GROUP = re.compile(r"[0-9]+")
#: No kind has a span of more digits.
MOST_DIGITS = 19
#: Words that announce a kind, or a number of another kind.
CUES = {
    "email": ("mail", "contact", "write", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "llame"),
    "other": ("version", "isbn", "order", "id", "no", "number", "release", "price", "date", "chapter", "page"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, each leftmost and non-overlapping within its kind."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        # the local part is the whole run before the sign, back to the last match
        reach = 256
        while True:
            low = max(end, at - reach)
            start = low + len(text[low:at].rstrip(LOCAL))
            if start > low or low == end:
                break
            reach *= 4  # a longer run: look further back
        if start < at and (m := DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> Iterator[Span]:
    """High recall: overlapping, one for each kind a span could be."""
    if "@" in text or " at " in text or "(at)" in text or "[at]" in text or "{at}" in text:
        yield from (("email", *m.span()) for m in SPELLED.finditer(text))
    if DIGIT.search(text):
        for m in DIGITS.finditer(text):
            for i, j, groups, n in sub_runs(text, *m.span()):
                if groups == 4 and n <= 12 or (i, j) == m.span():
                    yield "ip", i, j
                if n >= 12 or (i, j) == m.span():
                    yield "card", i, j
                if n <= 15 or (i, j) == m.span():
                    yield "phone", i, j


def sub_runs(text: str, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, groups, digits) of all runs of whole groups with 4 to MOST_DIGITS digits, and of the run itself up to 64 characters."""
    groups = [g.span() for g in GROUP.finditer(text, start, end)]
    for a, (i, _) in enumerate(groups):
        if i > start and text[i - 1] in "+(":
            i -= 1
        n = 0
        for b in range(a, len(groups)):
            n += groups[b][1] - groups[b][0]
            whole = a == 0 and b + 1 == len(groups) and end - start <= 64
            if n > MOST_DIGITS:
                break
            if n >= 4 and not whole:
                yield i, groups[b][1], b + 1 - a, n
    n = sum(j - i for i, j in groups)
    if n >= 4 and end - start <= 64:
        yield start, end, len(groups), n


JOINED_LEFT = re.compile(r"[0-9]([ ().\-/\[\]]{0,3})[+(]?$")
JOINED_RIGHT = re.compile(r"([ ().\-/\[\]]{0,3})[+(]?[0-9]")


def features(text: str, span: Span) -> list[float]:
    """Form and context of a candidate; the same columns for all kinds."""
    kind, i, j = span
    s = text[i:j]
    digits = "".join(c for c in s if c.isdigit())
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, i - 32) : i].lower(), text[j : j + 24].lower()
    near = re.findall(r"[a-z]+", before)[-3:] + re.findall(r"[a-z]+", after)[:1]
    own = [any(w.startswith(c) for w in near for c in CUES[kind]), any(w.startswith(c) for w in near for k, cues in CUES.items() if k != kind for c in cues)]
    octets = [int(g[-4:]) for g in groups]
    left, right = JOINED_LEFT.search(text[max(0, i - 8) : i]), JOINED_RIGHT.match(text[j : j + 8])
    return [
        float(KINDS.index(kind)), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(digits)) if digits else 0.0, s.count("."), s.count("-"), s.count(" "), s.count("("), s.count("["), s.count("/"), s.count("@"),
        float(s[:1] == "+"), float(" at " in s), float(" dot " in s), float("at)" in s or "at]" in s or "at}" in s or "dot)" in s or "dot]" in s or "dot}" in s),
        max(octets, default=0), float(len(groups) == 4 and max(octets) <= 255), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(before[-1:].isalnum() or before[-1:] in "._-"), float(after[:1].isalnum() or after[:1] in "_-"), float(before[-1:] in "$€£#="), float(after[:1] == "%"), *map(float, own),
        len(s.rpartition(".")[2]) if kind == "email" else 0, float(digits[:1] == "0"), float(digits[:2] in ("19", "20")),
        -1.0 if left is None else float(len(left[1])), -1.0 if right is None else float(len(right[1])), float(" " in left[1]) if left else -1.0, float(" " in right[1]) if right else -1.0, len(set(re.findall(r"[^0-9]+", s))),
    ]


def rewritten(kind: str, s: str, seed: int) -> list[str]:
    """Forms of a found span that the fixed patterns miss."""
    if kind == "email":
        a, _, b = s.partition("@")
        return [f"{a} at {b.replace('.', ' dot ')}", f"{a}(at){b}", f"{a} [at] {b.replace('.', ' [dot] ')}"]
    digits = "".join(c for c in s if c.isdigit())
    if kind == "ip":
        return [s.replace(".", "[.]"), s.replace(".", "(.)")]
    if kind == "card":
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours)]
    tail = digits[-10:]
    return [f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"00{digits[:-10]} {tail[:3]} {tail[3:]}"][seed % 2 :]


def decoys(seed: int) -> list[str]:
    """Numbers that are nobody's: dates, times, versions, prices, amounts, plain numbers."""
    r = np.random.default_rng(seed)
    n = lambda a, b: int(r.integers(a, b))
    return [
        f"{n(1900, 2040)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29):02}.{n(1, 13):02}.{n(1900, 2040)}", f"{n(1, 13):02}/{n(1, 29):02}/{n(1900, 2040)}", f"{n(0, 24):02}:{n(0, 60):02}", f"{n(0, 30)}.{n(0, 30)}.{n(0, 300)}",
        f"{n(1, 900)}.{n(10, 99)}", str(n(1000, 10**12)), f"{n(10**5, 10**6)}-{n(1000, 10**7)}", f"{n(1900, 2000)}-{n(2000, 2040)}", f"978-{n(0, 10)}-{n(100, 999)}-{n(10000, 99999)}-{n(0, 10)}", f"{n(1, 99)} {n(100, 999)} {n(100, 999)}",
    ]


def examples(text: str, seed: int) -> Iterator[tuple[list[float], int, str]]:
    """(features, label, kind) from one text."""
    base = base_spans(text)
    taken = Taken(base)
    for kind, i, j in base:
        yield features(text, (kind, i, j)), 1, kind
        for other in KINDS:
            if other != kind and other != "email":
                yield features(text, (other, i, j)), 0, other
        for s in rewritten(kind, text[i:j], seed):
            around = text[max(0, i - 64) : i] + s + text[j : j + 64]
            at = min(i, 64)
            yield features(around, (kind, at, at + len(s))), 1, kind
            if kind == "email":
                continue
            # the same beside another number; pieces of both together are nobody's
            for other in (s, decoys(seed + i + 1)[(seed + i) % len(decoys(0))]):
                between = (" ", " / ", " - ", " ")[(seed + i + len(s)) % 4]
                for lead in (True, False):
                    pair = s + between + other if lead else other + between + s
                    around = text[max(0, i - 64) : i] + pair + text[j : j + 64]
                    own = [(at, at + len(s))] if lead else [(at + len(pair) - len(s), at + len(pair))]
                    if other == s:
                        own = [(at, at + len(s)), (at + len(pair) - len(s), at + len(pair))]
                    for a, b in own:
                        yield features(around, (kind, a, b)), 1, kind
                    for k, a, b in candidates(around):
                        if k == kind and (a, b) not in own and at < b and a < at + len(pair):
                            yield features(around, (k, a, b)), 0, k
        for s in decoys(seed + i):
            around = text[max(0, i - 64) : i] + s + text[j : j + 64]
            at = min(i, 64)
            for other in KINDS[1:]:
                yield features(around, (other, at, at + len(s))), 0, other
    for kind, i, j in candidates(text):
        if taken.free(i, j):
            yield features(text, (kind, i, j)), 0, kind


@dataclass(frozen=True)
class Model:
    trees: Boosted
    thresholds: dict[str, float]

    def find(self, text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        if not self.thresholds:
            return base, []
        taken = Taken(base)
        open_ = [s for s in candidates(text) if s[0] in self.thresholds and taken.free(s[1], s[2])]
        if not open_:
            return base, []
        z = self.trees.logit(np.array([features(text, s) for s in open_]))
        return base, free_of([(p, s) for p, s in zip(z.tolist(), open_, strict=True) if p >= self.thresholds[s[0]]], base)


def counted(docs: DataFrame) -> DataFrame:
    """(x, y, kind, held, n): the examples of all texts and how often a task saw them. docs: (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, int, str, bool], int] = {}

        def sent() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(k[0] for k in held), np.float32)
            wide = len(x) // len(held)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, wide, dtype=np.int32)), pa.array(x))
            return pa.record_batch([lists, pa.array([k[1] for k in held], pa.int32()), pa.array([k[2] for k in held]), pa.array([k[3] for k in held]), pa.array(list(held.values()), pa.int64())], names=["x", "y", "kind", "held", "n"])

        for t in (t for b in batches for t in b.column("text").to_pylist() if t):
            seed = zlib.crc32(t.encode())
            rows = examples(t, seed)
            while part := list(islice(rows, PORTION)):  # a long text may give very many
                x = np.array([r[0] for r in part], np.float32)
                for v, (_, y, kind) in zip(x, part, strict=True):
                    key = v.tobytes(), y, kind, seed % 3 == 0
                    held[key] = held.get(key, 0) + 1
                if len(held) >= COUNTED:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    return docs.mapInArrow(run, "x array<float>, y int, kind string, held boolean, n long")


def fit(spark: SparkSession, docs: DataFrame) -> Model:
    """docs: (doc_id, text)."""
    ship(spark)
    rows = staged(spark, counted(docs.select("text")), "examples")
    counts = {(r.kind, r.y): r.n for r in rows.groupBy("kind", "y").agg(F.sum("n").alias("n")).collect()}
    if not any(y for _, y in counts):
        return Model(Boosted(), {})
    wide = rows.select(F.size("x").alias("n")).first().n
    most = max(counts.values())
    often = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("y") == y), F.col("n") * (most // m)) for (k, y), m in counts.items()])
    at = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    values = rows.select(often.alias("often"), F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.sum("often").alias("often"))
    cuts = [np.unique(np.array(r.q)) for r in values.groupBy("f").agg(F.percentile("v", at, F.col("often")).alias("q")).orderBy("f").collect()]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("x").flatten()).reshape(-1, wide)
            code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1).astype(np.uint8)
            y, n = b.column("y").to_numpy(), b.column("n").to_numpy()
            yield pa.record_batch([pa.array([r.tobytes() for r in code], pa.binary()), b.column("kind"), b.column("held"), pa.array(n * y), b.column("n")], names=["b", "kind", "held", "p", "n"])

    binned = rows.mapInArrow(bins, "b binary, kind string, held boolean, p long, n long").groupBy("b", "kind", "held").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    binned = staged(spark, binned, "binned")
    discard(spark, rows)
    sides = {r.held: r.p for r in binned.groupBy("held").agg(F.sum("p").alias("p")).collect()}
    trees, steps = boost_rows(spark, binned.where(~F.col("held")) if True in sides and sides.get(False) else binned, cuts)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = stepped(steps, codes(b, wide), np.full(b.num_rows, trees.start))
            yield pa.record_batch([b.column("kind"), pa.array(np.floor(z * STEPS).astype(np.int64)), b.column("p"), b.column("n")], names=["kind", "step", "p", "n"])

    by_step = binned.where("held").mapInArrow(levels, "kind string, step long, p long, n long").groupBy("kind", "step").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    found = by_step.orderBy(F.desc("step")).toPandas()  # a few thousand rows: log-odds of so many trees are bounded
    discard(spark, binned)
    thresholds = {}
    for kind in KINDS:
        own = found[found["kind"] == kind]
        if own["p"].sum() < LEAST_POSITIVES:
            continue
        good = np.nonzero(np.cumsum(own["p"].to_numpy()) >= PRECISION * np.cumsum(own["n"].to_numpy()))[0]
        if len(good):
            thresholds[kind] = max(0.0, float(own["step"].to_numpy()[good[-1]]) / STEPS)
    return Model(trees, thresholds)


def scan(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``_found`` to all columns of ``docs``."""
    ship(spark)
    return found_in(docs, model.find, KINDS)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = scan(spark, docs, fit(spark, docs))
    return out.select("doc_id", *(f"_found.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")))
