import random

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.losses import LOSSES


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "w string").select(f(F.col("w")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (T.numify, "2000-12-12", "*d**d**d**d*-*d**d*-*d**d*"), (T.numify, "abc1", "abc1"), (T.numify, "ab1", "ab*d*"), (T.numify, "", ""),
        (T.caseabstract, "B2B", "ADA"), (T.caseabstract, "W.", "AS"), (T.datify, "1996-08-30x", "*date*"), (T.datify, "96-08-30", "96-08-30"),
        (T.first_word, "Foo bar", "foo"), (T.tag_name, "B-LOC", "LOC"), (T.tag_name, "O", "O"), (T.title_hyphen, "Al-Kaida", True), (T.capital_period, "W.", True), (T.mixedcase, "McDonald", True),
        (lambda w: T.suffix(w, 4), "ab", "ab"), (lambda w: T.prefix(w, 3), "abcd", "abc"), (T.ispunctuation, ";", True), (T.ispunctuation, ";;", False), (lambda w: T.isdigit(w, 2), "12", True),
    ],
)
def test_fixtures(spark, f, value, expected):
    assert one(spark, value, f) == expected


ENDS, STARTS = set("?!)\";}]*:@'({["), set("(\"`{[:;&#*@)}]-,")


def by_hand(text):
    """The tokens, by a walk over the characters."""

    def several(i):
        for c in "-.":
            if text.startswith(c * 2, i):
                return i + len(text[i:]) - len(text[i:].lstrip(c))
        j, n = i, 0
        while text[j : j + 1] == "." and text[j + 1 : j + 2].isspace():
            j, n = j + 2, n + 1
        while n >= 2:  # dots with blanks between, and a last dot
            if text[j : j + 1] == ".":
                return j + 1
            j, n = j - 2, n - 1
        return None

    def over(i, mark=True):
        return i == len(text) or text[i].isspace() or text[i] in ENDS or several(i) is not None or (mark and text[i] in ",." and over(i + 1, False))

    out, i = [], 0
    while i < len(text):
        j = several(i)
        if j is None and text[i] not in STARTS and not text[i].isspace():
            j = i + 1
            while not over(j):
                j += 1
        if j is None and not text[i].isspace():
            j = i + 1
        if j is not None:
            out.append(text[i:j])
        i = j or i + 1
    return out


def test_tokenizer(spark):
    rnd = random.Random(5)
    parts = ["word", "Mr", "it's", ",", ".", "...", "--", "-", " ", "  ", "\n", "(", ")", "'", "\"", "1.5", "a,b", "www.x.org", "!", "?", ";", ":", "[", "]", "{", "}", "*", "@", "&", "#", "`", ". . .", "é", "x-y", "$3"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + ["See (the) shop's page, at www.shop.org... or -- well -- don't."]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokenize(F.col("t")).alias("x")).collect()
    assert all(r.x == by_hand(texts[r.i]) for r in got), [(texts[r.i], r.x, by_hand(texts[r.i])) for r in got if r.x != by_hand(texts[r.i])][:3]
    assert by_hand(texts[-1]) == ["See", "(", "the", ")", "shop", "'s", "page", ",", "at", "www.shop.org", "...", "or", "--", "well", "--", "don", "'t", "."]


def test_shapes_like_python(spark):
    words = ["Peter", "PETER", "peter", "O'Neil", "x-y", "-x", "x-", "A1", "12", "", "Mc-Donald", "a-", "--", "---", "U.S."]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", *(f(F.col("w")).alias(n) for n, f in (("title", T.istitle), ("upper", T.isupper), ("lower", T.islower), ("digit", T.isdigit), ("alnum", T.isalnum), ("hyphen", T.inner_hyphen)))).collect()
    for r in rows:
        assert (r.title, r.upper, r.lower, r.digit, r.alnum, r.hyphen) == (r.w.istitle(), r.w.isupper(), r.w.islower(), r.w.isdigit(), r.w.isalnum(), "-" in r.w[1:-1]), r.w


def test_feature_names(spark):
    rows = spark.createDataFrame([("a",), ("",), ("False",), (None,), ("0",)], "v string")
    assert [r.x for r in rows.select(T.feature_name(F.lit("k"), F.col("v")).alias("x")).collect()] == ["k=a", None, None, None, None]


def test_losses_column_and_numpy_agree(spark):
    grid = [(p / 4, y) for p in range(-100, 101, 7) for y in (-1.0, 1.0)]
    df = spark.createDataFrame(grid, "p double, y double")
    for name, loss in LOSSES.items():
        for r in df.select("p", "y", loss.loss(F.col("p"), F.col("y")).alias("l"), loss.pull(F.col("p"), F.col("y")).alias("g")).collect():
            assert r.l == pytest.approx(loss.value(r.p, r.y), abs=1e-9), name
            assert r.g == pytest.approx(loss.step(r.p, r.y), abs=1e-9), name


def test_modified_huber_fixture():
    f = LOSSES["modified_huber"]
    assert [f.value(z, 1) for z in (-2, -1, 0, 0.5, 1)] == [8, 4, 1, 0.25, 0]
    assert [f.step(z, 1) for z in (-2, -1, 0, 0.5, 1)] == [4, 4, 2, 1, 0]
