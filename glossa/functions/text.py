"""String functions on columns. Classes of characters are ASCII; lengths and affixes count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "<s>", "</s>"
#: Single-character punctuation tokens.
PUNCTUATION = tuple("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

#: Fixed value: the word pattern of the published Punkt tokenizer (Kiss and Strunk 2006), with a full stop cut off as a comma is:
#: several hyphens or dots; a word up to white space, a character that ends words, or a last comma or full stop; any other character.
TOKEN = r"""((?:-{2,}|\.{2,}|(?:\.\s){2,}\.)|(?=[^(\"`{\[:;&#*@)}\]\-,])\S+?(?=\s|$|[?!)\";}\]*:@'({\[]|(?:-{2,}|\.{2,}|(?:\.\s){2,}\.)|,(?=$|\s|[?!)\";}\]*:@'({\[]|(?:-{2,}|\.{2,}|(?:\.\s){2,}\.))|\.(?=$|\s|[?!)\";}\]*:@'({\[]|(?:-{2,}|\.{2,}|(?:\.\s){2,}\.)))|\S)"""


def tokenize(text: Column) -> Column:
    """Array of word and punctuation tokens."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def numify(w: Column) -> Column:
    """Digits become ``*d*`` unless the word has more than two other characters."""
    return F.when(F.length(F.regexp_replace(w, "[0-9]", "")) > 2, w).otherwise(F.regexp_replace(w, "[0-9]", "*d*"))


def caseabstract(w: Column) -> Column:
    """Each character by its class: A, a, D or S."""
    marked = F.regexp_replace(F.regexp_replace(w, "[^A-Za-z0-9]", "\u0001"), "[0-9]", "\u0002")
    return F.translate(F.regexp_replace(F.regexp_replace(marked, "[A-Z]", "A"), "[a-z]", "a"), "\u0001\u0002", "SD")


def datify(w: Column) -> Column:
    return F.when(w.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit("*date*")).otherwise(w)


def istitle(w: Column) -> Column:
    return w.rlike("^[^A-Za-z]*([A-Z][a-z]*([^A-Za-z]+|$))+$")


def isupper(w: Column) -> Column:
    return w.rlike("[A-Z]") & ~w.rlike("[a-z]")


def islower(w: Column) -> Column:
    return w.rlike("[a-z]") & ~w.rlike("[A-Z]")


def isdigit(w: Column, n: int | None = None) -> Column:
    return w.rlike(f"^[0-9]{{{n}}}$" if n else "^[0-9]+$")


def isalnum(w: Column) -> Column:
    return w.rlike("^[A-Za-z0-9]+$")


def inner_hyphen(w: Column) -> Column:
    """A hyphen that is neither the first nor the last character."""
    return w.rlike("(?s)^.+-.+$")


def mixedcase(w: Column) -> Column:
    return w.rlike("^[A-Z][A-Za-z0-9_]+[A-Z][A-Za-z0-9_]*$")


def capital_period(w: Column) -> Column:
    return w.rlike(r"^[A-Z]\.$")


def title_hyphen(w: Column) -> Column:
    return w.rlike("^[A-Z][a-z]+-[A-Z][a-z]+$")


def ispunctuation(w: Column) -> Column:
    return w.isin(*PUNCTUATION)


def prefix(w: Column, n: int) -> Column:
    return F.substring(w, 1, n)


def suffix(w: Column, n: int) -> Column:
    return F.right(w, F.lit(n))


def joined(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def shapes(w: Column) -> Column:
    """Array of the names of the shapes that a word has."""
    tests = {"istitle": istitle(w), "isdigit": isdigit(w), "isupper": isupper(w), "inhyphen": inner_hyphen(w), "isalnum": isalnum(w)}
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))


def tag_name(tag: Column) -> Column:
    """LOC of B-LOC; a tag without a prefix is its own name."""
    return F.element_at(F.split(tag, "-"), -1)


def first_word(text: Column) -> Column:
    """First blank-separated piece in lower case."""
    return F.lower(F.split(text, " ").getItem(0))


def feature_name(kind: Column, value: Column) -> Column:
    """kind=value; null for values that count as absent: null, the empty text, False and 0."""
    s = value.cast("string")
    return F.when(s.isNotNull() & ~s.isin("", "False", "false", "0"), F.concat(kind, F.lit("="), s))
