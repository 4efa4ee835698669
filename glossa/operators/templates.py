"""Context features of tokens, as declarative template sets.

A template set is a list of (name, column) over a token row with its neighbours; the neighbours come from one window
(one sort for all), and all templates of a set leave the row through one explode. Outside the sentence the neighbour is
<s> or </s>. Names are fixed values, spellings included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .lexicon import BROWN_PREFIXES, member, small

WINDOW = {"cur": 0, "pre": -1, "2pre": -2, "post": 1, "2post": 2}
NEAR = ("cur", "pre", "post")
#: Words that announce a person's name.
TRIGGERS = {"en": ("Mr.", "Mr", "Mrs", "Mrs.", "Dr.", "Dr"), "de": ("Frau", "Herr", "Fr.", "Hr.")}
Template = tuple[str, Column]


def _kept(w: Column, kind: str) -> Column:
    return T.numify(w) if kind == "num" else T.datify(w) if kind == "date" else w


def _derive(kind: str) -> dict[str, Callable[[Column], Column]]:
    """What templates read of a word, by name: each is computed once for a token, not once for each position."""
    of = lambda f: lambda w: f(_kept(w, kind))
    raw = (lambda f: f) if kind == "num" else of  # tests of digits and letters look at the word before numify
    out = {
        **({} if kind == "word" else {kind: of(lambda w: w)}), "title": of(T.istitle), "upper": of(T.isupper), "lower": of(T.islower), "hyphen": of(T.inner_hyphen), "punct": of(T.ispunctuation), "digit": raw(T.isdigit), "alnum": raw(T.isalnum),
        "mixed": T.mixedcase, "ccwp": T.capital_period, "tcsh": T.title_hyphen, "abstract": T.caseabstract, "digit2": of(lambda w: T.isdigit(w, 2)), "digit4": of(lambda w: T.isdigit(w, 4)), "length": of(F.length),
    }
    return out | {f"suffix{n}": of(lambda w, n=n: T.suffix(w, n)) for n in (1, 2, 3, 4)} | {f"prefix{n}": of(lambda w, n=n: T.prefix(w, n)) for n in (1, 2, 3, 4)}


def _packed(fields: tuple[str, ...], kind: str | None, types: dict, get: Callable[[str], Column], absent: bool, read: tuple[str, ...] | None = None) -> Column:
    """A position: the fields, what is derived of the word by ``kind`` (of these only ``read``, if given), and the columns beside it."""
    more = [(F.lit(None).cast(t) if absent else get(c)).alias(c) for c, t in types.items()]
    derived = {} if kind is None else {n: f for n, f in _derive(kind).items() if read is None or n in read}
    return F.struct(*[get(f).alias(f) for f in fields], *[f(get("word")).alias(n) for n, f in derived.items()], *more)


def with_neighbours(tokens: DataFrame, fields: tuple[str, ...] = ("word",), keys: tuple[str, ...] = ("doc_id", "sent_id"), kind: str | None = None, beside: tuple[str, ...] = (), read: tuple[str, ...] | None = None) -> DataFrame:
    """Adds a struct @position for each of the five positions: the fields, what is derived of the word by ``kind`` (of these only ``read``, if given), and columns that are null beyond the sentence."""
    types = {c: tokens.schema[c].dataType for c in beside}
    pack = lambda get, absent: _packed(fields, kind, types, get, absent, read)
    packed = tokens.withColumn("@cur", pack(F.col, False))
    w = W.partitionBy(*keys).orderBy("tok_idx")
    edge = {-1: pack(lambda f: F.lit(T.START), True), 1: pack(lambda f: F.lit(T.END), True)}
    shifted = {f"@{p}": F.lag("@cur", -k).over(w) if k < 0 else F.lead("@cur", k).over(w) for p, k in WINDOW.items() if k}
    out = packed.withColumns(shifted)
    return out.withColumns({f"@{p}": F.coalesce(F.col(f"@{p}"), edge[-1 if k < 0 else 1]) for p, k in WINDOW.items() if k})


def at(field: str, position: str) -> Column:
    return F.col(f"`@{position}`")[field]


def _num(p: str) -> Column:
    return at("num", p)


def _affixes(prefix: str, suffix: str) -> list[Template]:
    out = [(suffix.format(n=n, p=p), at(f"suffix{n}", p)) for p in NEAR for n in (1, 2, 3, 4)]
    return out + [(prefix.format(n=n, p=p), at(f"prefix{n}", p)) for p in NEAR for n in (3, 4)]


def _words(unigram: str, bigram: str) -> list[Template]:
    out = [(unigram + p, _num(p)) for p in WINDOW]
    return [*out, (bigram + "pre_cur", T.joined(_num("pre"), _num("cur"))), (bigram + "cur_post", T.joined(_num("cur"), _num("post")))]


def _hyphen(p: str) -> str:
    return f"shape_hypen_{p}" if p in ("post", "2post") else f"shape_hyphen_{p}"


def _basic_shapes() -> list[Template]:
    out = []
    for p in WINDOW:
        out += [(f"shape_istitle_{p}", at("title", p)), (f"shape_isdigit_{p}", at("digit", p)), (f"shape_isupper_{p}", at("upper", p)), (_hyphen(p), at("hyphen", p)), (f"shape_isalnum_{p}", at("alnum", p))]
    return out


def rr09(pos_bigram_post: str = "pos_bigram_bigram_cur_post") -> list[Template]:
    out = _words("word_unigram_", "word_bigram_") + [(f"pos_{p}", at("pos", p)) for p in WINDOW]
    out += [("pos_bigram_pre_cur", T.joined(at("pos", "pre"), at("pos", "cur"))), (pos_bigram_post, T.joined(at("pos", "cur"), at("pos", "post"))), ("pos_posw_cur", T.joined(_num("cur"), at("pos", "cur")))]
    out += _basic_shapes() + _affixes("prefix_{n}_{p}", "suffix_{n}_{p}")
    return [*out, *((f"syn_np_{p}", at("chunk", p)) for p in NEAR), ("syn_npw_cur", T.joined(at("chunk", "cur"), _num("cur")))]


def rr09_brown() -> list[Template]:
    return rr09("pos_bigram_cur_post")


def rr09_aso() -> list[Template]:
    out = _words("uword_", "bword_") + [(f"upos_{p}", at("pos", p)) for p in WINDOW]
    out += [("bpos_pre_cur", T.joined(at("pos", "pre"), at("pos", "cur"))), ("bpos_cur_post", T.joined(at("pos", "cur"), at("pos", "post"))), ("bposw_cur", T.joined(_num("cur"), at("pos", "cur")))]
    out += _affixes("prefix{n}_{p}", "suffix{n}_{p}")
    return [*out, *((f"unp_{p}", at("chunk", p)) for p in NEAR), ("bnpw_cur", T.joined(at("chunk", "cur"), _num("cur")))]


#: Positions as the older sets spell them.
OLD = {"cur": "", "pre": "pre_", "2pre": "pre_pre_", "post": "post_", "2post": "post_post_"}


def _old(kind: str, far: bool) -> list[Template]:
    """far: also bigrams of the outer words, word length, and affixes of all five words."""
    name, word = (lambda p, rest: f"{OLD[p]}{rest}"), (lambda p: at(kind, p))
    out = [(name(p, "w"), word(p)) for p in WINDOW] + [(name(p, "pos"), at("pos", p)) for p in WINDOW]
    pairs = [("pre", "pre", "cur"), ("post", "cur", "post")] + ([("2pre", "2pre", "pre"), ("2post", "post", "2post")] if far else [])
    for p, a, b in pairs:
        out += [(name(p, "bigram"), T.joined(word(a), word(b))), (name(p, "pos_bigram"), T.joined(at("pos", a), at("pos", b)))]
    out.append(("pos_w", T.joined(word("cur"), at("pos", "cur"))))
    for p in WINDOW:
        shapes = {"istitle": "title", "isdigit": "digit", "isupper": "upper", "isalnum": "alnum", "hypen" if p in ("post", "2post") else "hyphen": "hyphen", "is2digit": "digit2", "is4digit": "digit4"}
        out += [(name(p, n), at(f, p)) for n, f in shapes.items()]
    if far:  # what goes by the name of a suffix is the prefix
        out += [("wlen", at("length", "cur"))] + [(name(p, f"w_suffix{n}"), at(f"prefix{n}", p)) for p in WINDOW for n in (1, 2, 3, 4)]
    else:
        out += [(name(p, f"w_suffix{n}"), at(f"suffix{n}", p)) for p in NEAR for n in (1, 2, 3, 4)] + [(name(p, f"w_prefix{n}"), at(f"prefix{n}", p)) for p in NEAR for n in (3, 4)]
    return [*out, ("np", at("chunk", "cur")), ("np_w", T.joined(at("chunk", "cur"), word("cur"))), ("pre_np", at("chunk", "pre")), ("post_np", at("chunk", "post"))]


def zj03() -> list[Template]:
    return _old("date", False)


def az05() -> list[Template]:
    return _old("word", True)


def best(lang: str) -> list[Template]:
    """The sets without parts of speech; the gazetteer flags are fields firstname and, in English, lastname."""
    out = _words("word_unigram_", "word_bigram_")
    shapes = {"islower": "lower", "istitle": "title", "isdigit": "digit", "isupper": "upper", "isalnum": "alnum", "mixedcase": "mixed", "ccwp": "ccwp", "abstract": "abstract", "ispunctuation": "punct", "tcsh": "tcsh"}
    for p in WINDOW:
        out += [*((f"shape_{n}_{p}", at(f, p)) for n, f in shapes.items()), (_hyphen(p), at("hyphen", p))]
    out += _affixes("prefix_{n}_{p}", "suffix_{n}_{p}")
    out += [(f"trg_name_{p}", trigger(p, lang)) for p in ("pre", "2pre")]
    for flag in ("firstname", "lastname") if lang == "en" else ("firstname",):
        out += [(f"gaz_{flag}_{p}", at(flag, p)) for p in NEAR]
    return out


def trigger(position: str, lang: str = "en", words: tuple[str, ...] | None = None) -> Column:
    """A title, or one of the given words, before a word in title case."""
    return _num(position).isin(*(TRIGGERS[lang] if words is None else words)) & at("title", "cur")


#: Template sets by name. The demo sets are the best sets.
SETS: dict[str, Callable[[], list[Template]]] = {
    "rr09": rr09, "rr09_brown": rr09_brown, "rr09_aso": rr09_aso, "zj03": zj03, "az05": az05,
    "en_best_v1": lambda: best("en"), "en_demo": lambda: best("en"), "de_best_v1": lambda: best("de"), "de_demo": lambda: best("de"),
}
#: Lexicons that a set reads, by parameter name; a set works without them, with no such features.
LEXICONS = {"rr09_brown": ("brown",), "en_best_v1": ("brown", "places", "firstnames", "lastnames"), "en_demo": ("brown", "places", "firstnames", "lastnames"), "de_best_v1": ("brown", "places", "orgs", "firstnames"), "de_demo": ("brown", "places", "orgs", "firstnames")}
#: The columns in which a token has what these lexicons know of it; the others go by their own names.
COLUMN = {"firstnames": "firstname", "lastnames": "lastname"}
FIELDS = {"rr09": ("word", "pos", "chunk"), "rr09_brown": ("word", "pos", "chunk"), "rr09_aso": ("word", "pos", "chunk"), "zj03": ("word", "pos", "chunk"), "az05": ("word", "pos", "chunk")}


#: The bags of words of the oldest set: first and last offset.
BAGS = ((-4, -1), (1, 4))


def bag_window(tokens: DataFrame, first: int, last: int, keys: tuple[str, ...] = ("doc_id", "sent_id")) -> DataFrame:
    """A row (ftype, fval) for each word from offset ``first`` to offset ``last``."""
    w = W.partitionBy(*keys).orderBy("tok_idx").rowsBetween(first, last)
    return tokens.withColumn("_bag", F.collect_list("word").over(w)).select(*tokens.columns, F.lit(f"bow{first}-{last}").alias("ftype"), F.explode("_bag").alias("fval"))


def register(name: str, build: Callable[[], list[Template]], fields: tuple[str, ...] = ("word",), lexicons: tuple[str, ...] = ()) -> None:
    """A template set of one's own. build: gives (name, column) pairs over ``at`` and the derived fields; fields: the token columns that it reads."""
    if name in SETS:
        raise ValueError(f"there is a template set {name!r} already")
    SETS[name], FIELDS[name], LEXICONS[name] = build, fields, lexicons


def _with_lexicons(base: DataFrame, own: tuple[str, ...], lexicons: dict[str, DataFrame], kind: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Looks each token up once, before the window; its neighbours get what was found with it."""
    beside: list[str] = []
    for flag, lexicon in (("firstname", "firstnames"), ("lastname", "lastnames")):
        if lexicon in own:
            base = member(base.withColumn("_n", _kept(F.col("word"), kind)), lexicons[lexicon], "_n", flag).drop("_n") if lexicon in lexicons else base.withColumn(flag, F.lit(False))
            beside.append(flag)
    for lexicon, code in (("brown", "bits"), ("places", "codes"), ("orgs", "codes")):
        if lexicon in own and lexicon in lexicons:
            found = small(lexicons[lexicon].select(F.col("token").alias("_token"), F.col(code).alias(lexicon)))
            base = base.join(found, F.col("word") == F.col("_token"), "left").drop("_token")
            beside.append(lexicon)
    return base, tuple(beside)


def _pair(n: str, v: Column) -> Column:
    return F.struct(F.lit(n).alias("ftype"), v.alias("fval"))


def _base(tokens: DataFrame, name: str, lexicons: dict[str, DataFrame] | None, keys: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...], str, tuple[str, ...]]:
    """The tokens with what their lexicons know; the fields, the kind of words, and the lexicons' columns."""
    fields, kind = _reads(name)
    base, beside = _with_lexicons(_fielded(tokens, fields, keys), LEXICONS.get(name, ()), lexicons or {}, kind)
    return base, fields, kind, beside


def _reads(name: str) -> tuple[tuple[str, ...], str]:
    """The fields of a token that a set reads, and the kind of its words."""
    return FIELDS.get(name, ("word",)), {"zj03": "date", "az05": "word"}.get(name, "num")


def _fielded(tokens: DataFrame, fields: tuple[str, ...], keys: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    return tokens.select(*keys, "tok_idx", *more, *[F.col(f) if f in tokens.columns else F.lit(None).cast("string").alias(f) for f in fields])


def _valued(name: str, beside: tuple[str, ...], wanted: Callable[[str], bool]) -> tuple[list[Template], list[Template]]:
    """(templates of one value, templates of a list of values) that a set makes of a token and its neighbours."""
    single = [(n, value(v)) for n, v in SETS[name]() if wanted(n)]
    if "brown" in beside:
        single += [(n, F.substring(at("brown", p), 1, k)) for p in WINDOW for k in BROWN_PREFIXES if wanted(n := f"brown_{k}_{p}")]
    several = [(f"gaz_{label}_{p}", F.filter(F.split(at(lexicon, p), ""), lambda c: c != "")) for lexicon, label in (("places", "place"), ("orgs", "org")) if lexicon in beside for p in NEAR]
    if name == "rr09_aso":
        several += [(f"shape_{p}", T.shapes(at("word", p))) for p in WINDOW]
    return single, [(n, v) for n, v in several if wanted(n)]


def _made(single: list[Template], several: list[Template]) -> Column:
    """The array of a row's features, absent ones among them."""
    none = F.array().cast("array<struct<ftype: string, fval: string>>")
    under = lambda n: lambda x: _pair(n, x)
    return F.concat(F.array(*[_pair(n, v) for n, v in single]) if single else none, *[F.coalesce(F.transform(v, under(n)), none) for n, v in several])


def features(tokens: DataFrame, name: str, lexicons: dict[str, DataFrame] | None = None, keys: tuple[str, ...] = ("doc_id", "sent_id"), wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """(keys, tok_idx, ftype, fval): the features of a template set, absent values left out.

    wanted: of which names; the others are never built. One lookup of each token, one window, one explode.
    """
    ids, wanted = [*keys, "tok_idx"], wanted or (lambda n: True)
    base, fields, kind, beside = _base(tokens, name, lexicons, keys)
    shifted = with_neighbours(base, fields, keys, kind, beside)
    single, several = _valued(name, beside, wanted)
    if name == "az05":
        w = W.partitionBy(*keys).orderBy("tok_idx")
        bags = [(f"bow{i}-{j}", i, j) for i, j in BAGS if wanted(f"bow{i}-{j}")]
        several += [(n, F.col(f"`@bow{i}`")) for n, i, _ in bags]
        shifted = shifted.withColumns({f"@bow{i}": F.collect_list("word").over(w.rowsBetween(i, j)) for _, i, j in bags})
    return shifted.select(*ids, F.inline(_made(single, several))).where("fval is not null")


@dataclass(frozen=True)
class Contexts:
    """The templates of a set, told apart by the positions that they read, so that each distinct context is made once.

    A template of one word has as many values as there are words, not tokens; one of two words, as many as there are
    pairs. shifted: (keys, tok_idx, @position of raw fields). groups: for each tuple of positions its templates of one
    value and of lists. lexicons: what a word is looked up in, once for each context. raw: templates of one value before ``value``. bags: rows (keys, tok_idx, ftype,
    fval) of templates that read whole windows, or None.
    """

    shifted: DataFrame
    ids: tuple[str, ...]
    groups: dict[tuple[str, ...], tuple[list[Template], list[Template]]]
    fields: tuple[str, ...]
    kind: str
    own: tuple[str, ...]
    lexicons: dict[str, DataFrame]
    raw: dict[str, Column]
    bags: DataFrame | None = None
    _made: dict[object, DataFrame] = field(default_factory=dict)

    @property
    def tokens(self) -> DataFrame:
        """The tokens with their neighbours, written once."""
        if "tokens" not in self._made:
            self._made["tokens"] = written(self.shifted.sparkSession, self.shifted, "neighbours")
        return self._made["tokens"]

    def shapes(self) -> dict[tuple[int, bool], list[tuple[str, ...]]]:
        """Groups by how many positions they read, and whether tags too: the same words stand in all positions, so such groups share their contexts."""
        out: dict[tuple[int, bool], list[tuple[str, ...]]] = {}
        for g in self.groups:
            out.setdefault((sum(p != "tags" for p in g), "tags" in g), []).append(g)
        return out

    @staticmethod
    def columns(group: tuple[str, ...]) -> dict[str, str]:
        """The columns of ``distinct`` that hold a group's positions, from left to right."""
        return {p: f"c{i}" for i, p in enumerate(sorted((p for p in group if p != "tags"), key=WINDOW.__getitem__))} | ({"tags": "tags"} if "tags" in group else {})

    def distinct(self) -> DataFrame:
        """The distinct contexts of all groups, counted in one pass and written once; _set tells the shape, n0, n1, ... are the numbers of tokens for each of its groups."""
        if "distinct" not in self._made:
            shapes = self.shapes()
            # types as text: what is absent beyond a sentence may be null in all positions
            types = {f"c{i}": next(f.dataType.simpleString() for f in self.shifted.schema if f.name.startswith("@") and f.name != "@tags") for i in range(max((n for n, _ in shapes), default=0))}
            types |= {"tags": self.shifted.schema["@tags"].dataType.simpleString()} if any(t for _, t in shapes) else {}
            rows = []
            for k, groups in enumerate(shapes.values()):
                for slot, g in enumerate(groups):
                    held = {c: p for p, c in self.columns(g).items()}
                    rows.append(F.struct(F.lit(k).alias("_set"), F.lit(slot).alias("_slot"), *[(F.col(f"`@{held[c]}`") if c in held else F.lit(None)).cast(t).alias(c) for c, t in types.items()]))
            counts = [F.sum((F.col("_slot") == i).cast("long")).alias(f"n{i}") for i in range(max(map(len, shapes.values())))]
            found = self.shifted.select(F.inline(F.array(*rows))).groupBy("_set", *types).agg(*counts)
            self._made["distinct"] = written(self.shifted.sparkSession, found, "distinct")
        return self._made["distinct"]

    def made(self, group: tuple[str, ...]) -> DataFrame:
        """(raw0, ..., n, ftype, fval, fname) of a group, written once."""
        if group not in self._made:
            self._made[group] = written(self.shifted.sparkSession, self.of(group).withColumn("fname", F.concat("ftype", F.lit("="), "fval")), "contexts")
        return self._made[group]

    def names(self, group: tuple[str, ...]) -> list[str]:
        return [n for part in self.groups[group] for n, _ in part]

    def of(self, group: tuple[str, ...]) -> DataFrame:
        """(raw0, ..., n, ftype, fval): the distinct contexts of a group with their number of tokens, a row for each feature."""
        at_, columns = [f"@{p}" for p in group], self.columns(group)
        shape, slot = next((k, groups.index(group)) for k, groups in enumerate(self.shapes().values()) if group in groups)
        found = self.distinct().where((F.col("_set") == shape) & (F.col(f"n{slot}") > 0))
        # the raw contexts stay beside, to be joined with the tokens
        kept = found.select(F.col(f"n{slot}").alias("n"), *[F.col(columns[p]).alias(f"raw{i}") for i, p in enumerate(group)])
        asked = " ".join(str(v) for part in self.groups[group] for _, v in part)
        for i, a in enumerate(at_):
            if a == "@tags":
                kept = kept.withColumn(a, F.col(f"raw{i}"))
                continue
            own = tuple(x for x in self.own if f"{a}['{COLUMN.get(x, x)}']" in asked)
            looked = kept.withColumn("word", F.when(F.col(f"raw{i}")["_in"], F.col(f"raw{i}")["word"])) if own else kept
            looked, beside = _with_lexicons(looked, own, self.lexicons, self.kind)
            types = {c: looked.schema[c].dataType for c in beside}
            read = tuple(n for n in _derive(self.kind) if f"{a}['{n}']" in asked)
            packed = _packed(self.fields, self.kind, types, lambda f, i=i, beside=beside: F.col(f) if f in beside else F.col(f"raw{i}")[f], False, read)
            kept = looked.withColumn(a, packed).drop("word", *beside)
        return kept.select(*[f"raw{i}" for i in range(len(at_))], "n", F.inline(_made(*self.groups[group]))).where("fval is not null")

    def words(self, shape: int, groups: list[tuple[str, ...]]) -> DataFrame:
        """(@w, n0, n1, ...): contexts of one word, looked up and derived once for the positions of all groups, and written."""
        asked = " ".join(str(v) for g in groups for part in self.groups[g] for _, v in part)
        read = lambda n: any(f"@{g[0]}['{n}']" in asked for g in groups)
        own = tuple(x for x in self.own if read(COLUMN.get(x, x)))
        looked = self.distinct().where(F.col("_set") == shape)
        looked = looked.withColumn("word", F.when(F.col("c0")["_in"], F.col("c0")["word"])) if own else looked
        looked, beside = _with_lexicons(looked, own, self.lexicons, self.kind)
        types = {c: looked.schema[c].dataType for c in beside}
        packed = _packed(self.fields, self.kind, types, lambda f: F.col(f) if f in beside else F.col("c0")[f], False, tuple(filter(read, _derive(self.kind))))
        return written(self.shifted.sparkSession, looked.select(packed.alias("@w"), *[f"n{i}" for i in range(len(groups))]), "words")

    def _of_words(self, shape: int, groups: list[tuple[str, ...]]) -> list[DataFrame]:
        """Parts of ``counts`` for groups of one position: a word leaves once, with a row for each feature in each position."""
        words = self.words(shape, groups)
        words = words.select(*[F.col("`@w`").alias(f"@{g[0]}") for g in groups], *[f"n{i}" for i in range(len(groups))])
        row = lambda t, v, i: F.struct(F.lit(t).alias("ftype"), v.alias("fval"), F.col(f"n{i}").alias("n"))
        under = lambda t, i: lambda x: row(t, x, i)
        single = [row(t, self.raw[t].cast("string"), i) for i, g in enumerate(groups) for t, _ in self.groups[g][0] if t in self.raw]
        # what isn't cut so is a list of one
        lists = {g: [(t, F.array(v)) for t, v in self.groups[g][0] if t not in self.raw] + self.groups[g][1] for g in groups}
        several = [F.transform(v, under(t, i)) for i, g in enumerate(groups) for t, v in lists[g]]
        parts = []
        if single:  # the same cut as in ``value``, made once behind all templates
            found = words.select(F.inline(F.array(*single))).where(F.col("fval").isNotNull() & ~F.col("fval").isin("", "false", "0") & (F.col("n") > 0))
            parts.append(found.withColumn("fval", F.when(F.col("fval") == "true", "True").otherwise(F.col("fval"))))
        if several:
            none = F.array().cast("array<struct<ftype: string, fval: string, n: bigint>>")
            parts.append(words.select(F.inline(F.concat(*[F.coalesce(v, none) for v in several]))).where("fval is not null and n > 0"))
        return parts

    def counts(self) -> DataFrame:
        """(ftype, fval, n): parts of the numbers of tokens with each feature, to be added up."""
        parts: list[DataFrame] = []
        for k, ((n, tags), groups) in enumerate(self.shapes().items()):
            parts += self._of_words(k, groups) if n == 1 and not tags else [self.of(g).select("ftype", "fval", "n") for g in groups]
        if self.bags is not None:
            parts.append(self.bags.select("ftype", "fval", F.lit(1).cast("long").alias("n")))
        return reduce(DataFrame.unionByName, parts)

    def looked_up(self, group: tuple[str, ...], rows: DataFrame, table: DataFrame, found: Column, how: str = "inner", most: int = 300_000) -> DataFrame:
        """Rows of tokens with ``found``, an aggregate of what a table (fname, ...) has for the features of a group; made once for each context.

        most: rows of a table that is broadcast; a row holds a few words or numbers.
        """
        raws = [f"raw{i}" for i in range(len(group))]
        lists = written(self.shifted.sparkSession, self.made(group).join(small(table, most), "fname").groupBy(*raws).agg(found), "known")
        keyed = rows.select("*", *[F.col(f"`@{p}`").alias(r) for p, r in zip(group, raws, strict=True)])
        return keyed.join(small(lists, most), raws, how).drop(*raws)


def contexts(tokens: DataFrame, name: str, lexicons: dict[str, DataFrame] | None = None, keys: tuple[str, ...] = ("doc_id", "sent_id"), wanted: Callable[[str], bool] | None = None, gold: bool = False, only: Callable[[DataFrame], DataFrame] | None = None) -> Contexts:
    """The features of a set as contexts. gold: with those of the given tags before a token. only: which tokens count, of those with their neighbours."""
    wanted = wanted or (lambda n: True)
    ids, lexicons = (*keys, "tok_idx"), lexicons or {}
    fields, kind = _reads(name)
    own = LEXICONS.get(name, ())
    single, several = _valued(name, tuple(COLUMN.get(x, x) for x in own if x in COLUMN or x in lexicons), wanted)
    single += [(n, v) for n, v in _history(name) if wanted(n)] if gold else []
    known = (name, keys, gold, tuple(n for n, _ in single + several), *sorted((k, id(v)) for k, v in lexicons.items()))
    if only is None and known in (memo := tokens.__dict__.setdefault("_contexts", {})):
        return memo[known]
    asked = " ".join(str(v) for _, v in single + several)
    if only is None:
        fields = tuple(f for f in fields if f == "word" or f"['{f}']" in asked)
    # of a word only what is read goes through the window; what lexicons know of it is looked up once for each context
    base = _fielded(tokens, fields, keys, ("tag",) if gold else ()).withColumn("_in", F.lit(True))
    shifted = with_neighbours(base, fields, keys, None, ("_in",) if own else ())
    if gold:
        w = W.partitionBy(*keys).orderBy("tok_idx")
        shifted = shifted.withColumn("@tags", F.struct(F.lag("tag", 1, T.START).over(w).alias("one"), F.lag("tag", 2, T.START).over(w).alias("two")))
    bags = None
    if name == "az05" and any(wanted(f"bow{i}-{j}") for i, j in BAGS):
        bags = reduce(DataFrame.unionByName, [bag_window(tokens.select(*ids, "word"), i, j, keys).select(*ids, "ftype", "fval") for i, j in BAGS if wanted(f"bow{i}-{j}")])
    if only is not None:
        shifted = only(shifted)
        bags = None if bags is None else bags.join(shifted.select(*ids), list(ids), "left_semi")
    groups: dict[tuple[str, ...], tuple[list[Template], list[Template]]] = {}
    for which, templates in enumerate((single, several)):
        for n, v in templates:
            group = tuple(p for p in (*WINDOW, "tags") if f"@{p}[" in str(v))
            groups.setdefault(group, ([], []))[which].append((n, v))
    shifted = shifted.select(*ids, *[f"`@{p}`" for p in (*WINDOW, "tags") if any(p in g for g in groups)])
    out = Contexts(shifted, ids, groups, fields, kind, own, lexicons, dict(SETS[name]()), bags)
    if only is None:  # the same table of tokens is asked for its vocabulary, and again for its rows
        memo[known] = out
    return out


def value(v: Column) -> Column:
    """As text; null for what counts as absent: false, 0, the empty text."""
    s = v.cast("string")
    s = F.when(s == "true", F.lit("True")).otherwise(s)
    return F.when(s.isNotNull() & ~s.isin("", "false", "0"), s)


def _history(name: str) -> list[Template]:
    """The templates of the tags before a token, over @tags and the words around; the words are as ``numify`` keeps them."""
    tags = F.col("`@tags`")
    one, two = tags["one"], tags["two"]
    if name in ("zj03", "az05"):
        return [("pre_tag", one), ("pre_pre_tag", two), ("pre_tag_w", T.joined(one, at("word", "cur"))), ("tag_bigram", T.joined(two, one))]
    unigram, word, bigram = ("utag_", "btagw_pre_", "btagw_2pre_pre") if name == "rr09_aso" else ("tag_tag_", "tag_pretagword_", "tag_bigram_2pre_pre")
    return [(unigram + "pre", one), (unigram + "2pre", two), *((word + p, T.joined(one, T.numify(at("word", p)))) for p in WINDOW), (bigram, T.joined(two, one))]


def history(tokens: DataFrame, name: str, tag: str = "tag", keys: tuple[str, ...] = ("doc_id", "sent_id")) -> DataFrame:
    """(keys, tok_idx, ftype, fval): features of the tags before a token, from the given tags."""
    w = W.partitionBy(*keys).orderBy("tok_idx")
    shifted = with_neighbours(tokens, ("word",), keys).withColumn("@tags", F.struct(F.lag(tag, 1, T.START).over(w).alias("one"), F.lag(tag, 2, T.START).over(w).alias("two")))
    return shifted.select(*keys, "tok_idx", F.inline(F.array(*[_pair(n, v) for n, v in _history(name)])))
