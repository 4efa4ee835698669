"""Secrets: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary learned on ordinary text spells ordinary words with few tokens and random strings with many. A
string of key characters with fewer than CHARS_PER_TOKEN characters for each token is taken for a secret, unless it is
random but public (a digest of a usual length, a UUID) or a name made of words of the vocabulary. Strings below SURE
characters need more tokens, the shorter the more, as chance weighs more. A run of key characters is tested whole, and
otherwise by the stretches between its words, so a key behind a path is found.

Defined cases: null and empty texts hold no spans; texts of any length are searched whole, in time that grows with them;
repeated rows are each searched; an empty table gives an empty
result; other columns are ignored (op6) or kept (redact).
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import clip_columns, spare, table
from .spans import Span, found_in, free_of

KINDS = ("assign", "access", "hex", "random")
CHARS_PER_TOKEN = 2.0
#: Below so many characters a string needs one token more for every four that are missing.
SURE = 20
#: Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)

ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{7,}")
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])"
PART = re.compile(rf"{UUID}|[A-Za-z0-9]+")
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Words within a name, by capitals and digits.
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Numbers, perhaps with a unit or a mark.
NUMBER = re.compile(r"[A-Za-z]{0,2}[0-9]{1,8}(?:[A-Za-z][0-9]{1,8})?[A-Za-z]?")
_LOADED: dict = {}


def vocabulary(path: str):
    """A tiktoken encoding of a vocabulary file, once for each process."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def base_spans(text: str) -> list[Span]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def public(s: str) -> bool:
    return "-" in s or len(s) in DIGESTS and HEXADECIMAL.fullmatch(s) is not None


def is_word(s: str, path: str) -> bool:
    """One token behind a space, in lower case or with a capital."""
    low, known = s.lower(), vocabulary(path)
    return any(len(known.encode_ordinary(x)) == 1 for x in (f" {low}", f" {low.capitalize()}", s))


def is_name(s: str, path: str) -> bool:
    """Made of words, most of it of words of three letters or more, perhaps with short numbers."""
    pieces = PIECE.findall(s)
    letters = [p for p in pieces if p.isalpha()]
    long = sum(len(p) for p in letters if len(p) > 2)
    if not letters or 5 * long < 3 * sum(map(len, letters)) or any(len(p) > 4 for p in pieces if p.isdigit()):
        return False
    return all(is_word(p, path) for p in letters)


def plain(s: str, path: str) -> bool:
    """Letters of one case, perhaps with one capital in front, that the vocabulary spells well: no key."""
    return s.isalpha() and (s.islower() or s.isupper() or s[1:].islower()) and random_ratio(s, path) is None


def random_ratio(s: str, path: str) -> float | None:
    """Characters for each token, if so few that the string is random."""
    tokens = len(vocabulary(path).encode_ordinary(s))
    return len(s) / tokens if CHARS_PER_TOKEN * (tokens - max(0, SURE - len(s)) / 4) > len(s) else None


def random_spans(text: str, held: list[Span], path: str) -> list[Span]:
    """Strings that the vocabulary spells badly."""
    found = []
    for m in RUN.finditer(text):
        if plain(m[0], path):
            continue
        # parts that hold no key; a long or public one ends a stretch, a short one may stand within a key
        parts = [(p.start(), p.end(), public(p[0]), public(p[0]) or plain(p[0], path) or NUMBER.fullmatch(p[0]) is not None or is_name(p[0], path)) for p in PART.finditer(m[0])]
        known = any(p[2] for p in parts)
        whole, stretches = [p for p in parts if not p[3]], [[]]
        if not whole:
            continue
        for p in parts:
            if p[2] or p[3] and p[1] - p[0] > 3:
                stretches.append([])
            else:
                stretches[-1].append(p)
        lead = [] if known else [(len(m[0]) - len(m[0].lstrip("=-_/+")), len(m[0].rstrip("=-_/+")))]
        for spans in (lead, [(own[0][0], own[-1][1]) for x in stretches if (own := [p for p in x if not p[3]])]):
            good = [(-r, ("random", m.start() + i, m.start() + j)) for i, j in spans if (r := random_ratio(m[0][i:j], path)) is not None]
            found += good
            if good:
                break
    return free_of(found, held)


def finder(path: str | None = None):
    path = path or vocabulary_path()

    def find(text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        return base, random_spans(text, base, path)

    return find


def scan(spark: SparkSession, docs: DataFrame, path: str | None = None, out: str = "_found") -> DataFrame:
    """Adds ``out`` to all columns of ``docs``."""
    ship(spark)
    return found_in(docs, finder(path), KINDS, out=out)


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same rows and columns; every secret in the text is replaced by its kind."""
    out = spare(docs, "_found")
    return scan(spark, docs, out=out).withColumn("text", F.coalesce(F.col(out)["clean"], "text")).drop(out)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark, clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", *(f"_found.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")))
