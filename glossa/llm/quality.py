"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean column. On a bounded sample the operator measures for each rule what it costs and how much it
rejects, orders the rules by rejection per cost, and evaluates them as one CASE expression: a row that a rule rejects
never pays for the rules behind it. The order moves work, never verdicts.

Defined cases: a null or empty text has no words and fails the base rules; texts of any length are measured whole, in time
that grows with their length but for the sort; an empty table gives an empty result; rules of equal rank go by name, and
the verdict ``kept`` is the same in every order; repeated rows are judged each on its own; other columns are ignored
(``op1``) or passed through (``cascade``).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, clip_columns, table, words

#: Rows on which costs and rejection rates are estimated. Only the order of evaluation depends on them.
SAMPLE_ROWS = 512


@dataclass(frozen=True)
class Rule:
    """A named condition under which a document is rejected."""

    name: str
    rejects: Column


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules read; all of them come from arrays within the row, so nothing is shuffled.

    n_repeat_words: each 3-word window has a 64-bit hash. One sort of longs tells whether any occurs twice; only then are
    the hashes sorted again with their positions, and the windows that have an equal neighbour cover their words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", words(F.col(text))).withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_lines", F.size("_l").cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    at = lambda i, j: F.get(F.col("_w"), i + j)
    windows = F.when(F.col("n_words") < 3, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 3, F.lit(0)).cast("int")), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))
    )
    d = d.withColumn("_h", windows).withColumn("_s", F.sort_array("_h"))
    d = d.withColumn("_twice", F.exists(F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))), lambda j: F.coalesce(F.get("_s", j) == F.get("_s", j - 1), F.lit(False))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("_s", F.when(F.col("_twice"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))

    def repeated(x: Column, j: Column) -> Column:
        before, after = F.get(F.col("_s"), j - 1), F.get(F.col("_s"), j + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_s", repeated), lambda x: x["i"].cast("long"))))
    # a window covers three words, or as many as there are before the next repeated window starts
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_p", start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n")), lambda s: s["n"])
    return d.withColumn("n_repeat_words", covered).drop("_h", "_s", "_p", "_twice", "_w")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules on the metrics, and two that read the text again."""
    t = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    closed = F.regexp_count(t, F.lit(r"[.!?:;,]" + SPACE + r"|[.!?:;,]\z"))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 25 * F.col("n_words")),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))),
        Rule("shouting", 100 * capitals > 50 * letters),
        Rule("no_punctuation", (F.col("n_words") > 200) & (closed == 0)),
    ]


def ordered(spark: SparkSession, sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejection per cost, both measured on the sample; a rule that rejects nothing there goes last.

    The sample stays on the executors, in one task; what counting it takes without a rule is no rule's cost. Rules that
    come out even go by name.
    """
    rows = sample.limit(SAMPLE_ROWS).coalesce(1).persist()

    def measured(condition: Column) -> tuple[float, int, int]:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            n, hit = rows.agg(F.count(F.lit(1)), F.count(F.when(condition, 1))).first()
            best = min(best, time.perf_counter() - began)
        return best, n, hit

    try:
        bare, n, _ = measured(F.lit(True))
        scored = []
        for rule in rules:
            cost, _, hit = measured(rule.rejects)
            scored.append((-(hit / n if n else 0.0) / max(cost - bare, bare / 20), rule.name, rule))
    finally:
        rows.unpersist()
    return [rule for *_, rule in sorted(scored, key=lambda x: x[:2])]


def cascade(df: DataFrame, rules: list[Rule], reason: str = "rejected_by") -> DataFrame:
    """Adds the name of the first rule that rejects a row, or null; later rules aren't evaluated for that row."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return df.withColumn(reason, verdict if rules else F.lit(None).cast("string"))


def quality(spark: SparkSession, docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Metrics, base verdict and cascade verdict of each document; rules behind a failed base aren't evaluated."""
    rules = default_rules() if rules is None else rules
    measured = with_metrics(docs)
    rules = ordered(spark, with_metrics(docs.limit(SAMPLE_ROWS)), rules)
    judged = cascade(measured.withColumn("base_failed", base_failed()), [Rule("base", F.col("base_failed")), *rules])
    return judged.withColumn("kept", F.col("rejected_by").isNull())


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark, clip_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: op1 with the default rules, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, t, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
b AS (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words
  OR 100 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > 50 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) OR (n_words > 200 AND NOT regexp_matches(t, '[.!?:;,][\x20\x09-\x0D]|[.!?:;,]\z'))) AS kept FROM b
"""
