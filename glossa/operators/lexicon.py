"""Gazetteers, clusters, dictionaries. Their tables are word lists of known size and are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_word

BROWN_PREFIXES = (4, 6, 10, 20)
#: A lexicon beyond so many rows is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def iob_code(i: Column, n: Column) -> Column:
    return F.when(i == 0, "B").otherwise("I")


def bilou_code(i: Column, n: Column) -> Column:
    return F.when(n == 1, "U").when(i == 0, "B").when(i == n - 1, "L").otherwise("I")


def gazetteer(entries: DataFrame, encoding: str = "iob", case_sensitive: bool = True, entry: str = "entry") -> DataFrame:
    """(token, codes): for each token the letters of the places that it takes in entries, sorted."""
    code = {"iob": iob_code, "bilou": bilou_code}[encoding]
    text = F.trim(F.col(entry)) if case_sensitive else F.lower(F.trim(F.col(entry)))
    parts = entries.select(F.split(text, r"\s+").alias("p"))
    tokens = parts.select(F.size("p").alias("n"), F.posexplode("p").alias("i", "token")).where("token <> ''")
    return tokens.select("token", code(F.col("i"), F.col("n")).alias("c")).groupBy("token").agg(F.array_join(F.array_sort(F.collect_set("c")), "").alias("codes"))


def simple_gazetteer(entries: DataFrame, case_sensitive: bool = True, entry: str = "entry") -> DataFrame:
    word = F.rtrim(F.col(entry))
    return entries.select((word if case_sensitive else F.lower(word)).alias("token")).distinct()


def member(tokens: DataFrame, words: DataFrame, column: str = "word", out: str = "known", case_sensitive: bool = True) -> DataFrame:
    """Adds whether the word is in the list."""
    key = F.col(column) if case_sensitive else F.lower(F.col(column))
    marked = small(words.select(F.col("token").alias("_k"), F.lit(True).alias("_m")))
    return tokens.join(marked, key == F.col("_k"), "left").withColumn(out, F.coalesce("_m", F.lit(False))).drop("_k", "_m")


def lookup(tokens: DataFrame, codes: DataFrame, column: str = "word", out: str = "codes", case_sensitive: bool = True) -> DataFrame:
    """Adds the codes of the word in a coded gazetteer, null if it isn't there; looked up as it is or in lower case."""
    key = F.col(column) if case_sensitive else F.lower(F.col(column))
    found = small(codes.select(F.col("token").alias("_k"), F.col("codes").alias("_c")))
    return tokens.join(found, key == F.col("_k"), "left").withColumn(out, F.col("_c")).drop("_k", "_c")


def size(lexicon: DataFrame) -> int:
    """How many words a gazetteer or a table of clusters holds."""
    return lexicon.select("token").distinct().count()


def gazetteer_features(tokens: DataFrame, codes: DataFrame, name: str, column: str = "word", case_sensitive: bool = True) -> DataFrame:
    """A row (ftype, fval) for each code of the token."""
    found = lookup(tokens, codes, column, "_codes", case_sensitive).where("_codes is not null")
    return found.select(*tokens.columns, F.lit(name).alias("ftype"), F.explode(F.filter(F.split("_codes", ""), lambda c: c != "")).alias("fval"))


def brown_features(tokens: DataFrame, clusters: DataFrame, location: str = "cur", column: str = "word", prefixes: tuple[int, ...] = BROWN_PREFIXES) -> DataFrame:
    """A row (ftype, fval) for each prefix length; unknown words have none."""
    joined = tokens.join(small(clusters), F.col(column) == clusters["token"]).drop(clusters["token"])
    each = F.array(*[F.struct(F.lit(f"brown_{p}_{location}").alias("ftype"), F.substring("bits", 1, p).alias("fval")) for p in prefixes])
    return joined.select(*tokens.columns, F.inline(each))


def translate(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(fid_s, fid_t): source terms whose translation, normalised, is a target term. pairs: (ws, wt), one for each ws."""
    named = pairs.select(F.col("ws"), first_word(F.col("wt")).alias("wt"))
    s = source.select(F.col("term").alias("ws"), F.col("fid").alias("fid_s"))
    t = target.select(F.col("term").alias("wt"), F.col("fid").alias("fid_t"))
    return s.join(named, "ws").join(t, "wt").select("fid_s", "fid_t", "ws", "wt")
