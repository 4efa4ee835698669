"""DuckDB SQL for queries whose SQL is long: template sets, and learners as recursive queries over a table in row order.

Written from the definitions, apart from the operators: the lists of names below are fixed values.
"""

from __future__ import annotations

POSITIONS = ("cur", "pre", "2pre", "post", "2post")
NEAR = ("cur", "pre", "post")
ASCII_PUNCTUATION = r"'^[!-/:-@\[-`{-~]$'"


def numify(w: str) -> str:
    return f"CASE WHEN length(regexp_replace({w}, '[0-9]', '', 'g')) > 2 THEN {w} ELSE regexp_replace({w}, '[0-9]', '*d*', 'g') END"


def datify(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN '*date*' ELSE {w} END"


def flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 'True' END"


def tests(kept: str, raw: str, bare: str) -> dict[str, str]:
    """Tests of a word: of the kept form; of the raw word; ``bare`` is what digits and letters are looked for in."""
    return {
        "istitle": f"regexp_matches({kept}, '^[^A-Za-z]*([A-Z][a-z]*([^A-Za-z]+|$))+$')", "isupper": f"regexp_matches({kept}, '[A-Z]') AND NOT regexp_matches({kept}, '[a-z]')", "islower": f"regexp_matches({kept}, '[a-z]') AND NOT regexp_matches({kept}, '[A-Z]')",
        "hyphen": f"regexp_matches({kept}, '(?s)^.+-.+$')", "isdigit": f"regexp_matches({bare}, '^[0-9]+$')", "isalnum": f"regexp_matches({bare}, '^[A-Za-z0-9]+$')", "is2digit": f"regexp_matches({kept}, '^[0-9]{{2}}$')", "is4digit": f"regexp_matches({kept}, '^[0-9]{{4}}$')",
        "mixedcase": f"regexp_matches({raw}, '^[A-Z][A-Za-z0-9_]+[A-Z][A-Za-z0-9_]*$')", "ccwp": f"regexp_matches({raw}, '^[A-Z]\\.$')", "tcsh": f"regexp_matches({raw}, '^[A-Z][a-z]+-[A-Z][a-z]+$')", "ispunctuation": f"length({kept}) = 1 AND regexp_matches({kept}, {ASCII_PUNCTUATION})",
    }


def abstract(w: str) -> str:
    return f"translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace({w}, '[^A-Za-z0-9]', chr(1), 'g'), '[0-9]', chr(2), 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), chr(1) || chr(2), 'SD')"


def hyphen_name(p: str) -> str:
    return f"shape_hypen_{p}" if "post" in p else f"shape_hyphen_{p}"


def rr09_names(detector: str) -> list[tuple[str, str]]:
    """Columns k_, w_, p_, c_ with a position: the kept word, the word, its part of speech, its chunk."""
    aso = detector == "rr09_aso"
    word, two, pos, pair, tagged, np, npw = ("uword_", "bword_", "upos_", "bpos_", "bposw_cur", "unp_", "bnpw_cur") if aso else ("word_unigram_", "word_bigram_", "pos_", "pos_bigram_", "pos_posw_cur", "syn_np_", "syn_npw_cur")
    after = "pos_bigram_bigram_cur_post" if detector == "rr09" else pair + "cur_post"
    out = [(word + p, f"k_{p}") for p in POSITIONS] + [(two + "pre_cur", "concat_ws('/', k_pre, k_cur)"), (two + "cur_post", "concat_ws('/', k_cur, k_post)")]
    out += [(pos + p, f"p_{p}") for p in POSITIONS] + [(pair + "pre_cur", "concat_ws('/', p_pre, p_cur)"), (after, "concat_ws('/', p_cur, p_post)"), (tagged, "concat_ws('/', k_cur, p_cur)")]
    for p in POSITIONS if not aso else ():
        t = tests(f"k_{p}", f"w_{p}", f"w_{p}")
        out += [(f"shape_{n}_{p}", flag(t[n])) for n in ("istitle", "isdigit", "isupper", "isalnum")] + [(hyphen_name(p), flag(t["hyphen"]))]
    glue = "" if aso else "_"
    for p in NEAR:
        out += [(f"suffix{glue}{n}_{p}", f"right(k_{p}, {n})") for n in (1, 2, 3, 4)] + [(f"prefix{glue}{n}_{p}", f"left(k_{p}, {n})") for n in (3, 4)]
    return [*out, *((np + p, f"c_{p}") for p in NEAR), (npw, "concat_ws('/', c_cur, k_cur)")]


def old_names(detector: str) -> list[tuple[str, str]]:
    far = detector == "az05"
    before = {"cur": "", "pre": "pre_", "2pre": "pre_pre_", "post": "post_", "2post": "post_post_"}
    out = [(before[p] + "w", f"k_{p}") for p in POSITIONS] + [(before[p] + "pos", f"p_{p}") for p in POSITIONS]
    for p, a, b in (("pre", "pre", "cur"), ("post", "cur", "post"), ("2pre", "2pre", "pre"), ("2post", "post", "2post"))[: 4 if far else 2]:
        out += [(before[p] + "bigram", f"concat_ws('/', k_{a}, k_{b})"), (before[p] + "pos_bigram", f"concat_ws('/', p_{a}, p_{b})")]
    out.append(("pos_w", "concat_ws('/', k_cur, p_cur)"))
    for p in POSITIONS:
        t = tests(f"k_{p}", f"w_{p}", f"k_{p}")
        out += [(before[p] + n, flag(t[n])) for n in ("istitle", "isdigit", "isupper", "isalnum", "is2digit", "is4digit")] + [(before[p] + ("hypen" if "post" in p else "hyphen"), flag(t["hyphen"]))]
    if far:
        out += [("wlen", "length(k_cur)::VARCHAR")] + [(f"{before[p]}w_suffix{n}", f"left(k_{p}, {n})") for p in POSITIONS for n in (1, 2, 3, 4)]
    else:
        out += [(f"{before[p]}w_suffix{n}", f"right(k_{p}, {n})") for p in NEAR for n in (1, 2, 3, 4)] + [(f"{before[p]}w_prefix{n}", f"left(k_{p}, {n})") for p in NEAR for n in (3, 4)]
    return [*out, ("np", "c_cur"), ("np_w", "concat_ws('/', c_cur, k_cur)"), ("pre_np", "c_pre"), ("post_np", "c_post")]


def best_names(detector: str) -> list[tuple[str, str]]:
    english = detector.startswith("en")
    out = [(f"word_unigram_{p}", f"k_{p}") for p in POSITIONS] + [("word_bigram_pre_cur", "concat_ws('/', k_pre, k_cur)"), ("word_bigram_cur_post", "concat_ws('/', k_cur, k_post)")]
    for p in POSITIONS:
        t = tests(f"k_{p}", f"w_{p}", f"w_{p}")
        out += [(f"shape_{n}_{p}", flag(t[n])) for n in ("islower", "istitle", "isdigit", "isupper", "isalnum", "mixedcase", "ccwp", "ispunctuation", "tcsh")] + [(f"shape_abstract_{p}", abstract(f"w_{p}")), (hyphen_name(p), flag(t["hyphen"]))]
    for p in NEAR:
        out += [(f"suffix_{n}_{p}", f"right(k_{p}, {n})") for n in (1, 2, 3, 4)] + [(f"prefix_{n}_{p}", f"left(k_{p}, {n})") for n in (3, 4)]
    words = "'Mr.', 'Mr', 'Mrs', 'Mrs.', 'Dr.', 'Dr'" if english else "'Frau', 'Herr', 'Fr.', 'Hr.'"
    title = tests("k_cur", "w_cur", "w_cur")["istitle"]
    out += [(f"trg_name_{p}", flag(f"k_{p} IN ({words}) AND {title}")) for p in ("pre", "2pre")]
    out += [(f"gaz_firstname_{p}", flag(f"k_{p} IN (SELECT token FROM firstnames)")) for p in NEAR]
    return out + ([(f"gaz_lastname_{p}", flag(f"k_{p} IN (SELECT token FROM lastnames)")) for p in NEAR] if english else [])


NAMES = {"rr09": rr09_names, "rr09_brown": rr09_names, "rr09_aso": rr09_names, "zj03": old_names, "az05": old_names, "en_best_v1": best_names, "en_demo": best_names, "de_best_v1": best_names, "de_demo": best_names}


def window_sql(detector: str, source: str = "tokens") -> str:
    """nb: the tokens with their neighbours. source: a table with word, pos, chunk."""
    kept = {"zj03": datify, "az05": lambda w: w}.get(detector, numify)
    shift = {"cur": "{0}", "pre": "lag({0}, 1, '<s>') OVER s", "2pre": "lag({0}, 2, '<s>') OVER s", "post": "lead({0}, 1, '</s>') OVER s", "2post": "lead({0}, 2, '</s>') OVER s"}
    beside = ", ".join(f"{shift[p].format(c)} AS {n}_{p}" for p in POSITIONS for n, c in (("w", "word"), ("p", "pos"), ("c", "chunk")))
    return f"nb0 AS (SELECT doc_id, sent_id, tok_idx, {beside} FROM {source} WINDOW s AS (PARTITION BY doc_id, sent_id ORDER BY tok_idx)), nb AS (SELECT *, {', '.join(f'{kept(f"w_{p}")} AS k_{p}' for p in POSITIONS)} FROM nb0)"


def rows_sql(detector: str, name: str = "frows") -> str:
    """frows (doc_id, ftype, fval): the single-valued features of every token; absent values left out."""
    names, values = zip(*NAMES[detector](detector), strict=True)
    each = ", ".join(f"'{n}'" for n in names)
    return f"""{name} AS (SELECT doc_id, ftype, CASE WHEN fval = 'true' THEN 'True' ELSE fval END AS fval FROM (SELECT doc_id, unnest([{each}]) AS ftype, unnest([{', '.join(values)}]) AS fval FROM nb) WHERE fval IS NOT NULL AND fval NOT IN ('', 'false', '0'))"""


def title_words(column: str) -> str:
    return f"list_aggregate(list_transform(string_split(lower({column}), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ')"


def templates_sql(detector: str, tokens: str, gazetteer: str, bits: str) -> str:
    """(ftype, n, chars) of a template set. tokens, gazetteer: common table expressions; bits: the cluster of ``word``."""
    parts = [rows_sql(detector)]
    union = ["SELECT ftype, fval FROM frows"]
    if detector == "rr09_aso":
        t = {p: tests(f"w_{p}", f"w_{p}", f"w_{p}") for p in POSITIONS}
        union += [f"SELECT 'shape_{p}', unnest(list_filter([{', '.join(f"CASE WHEN {t[p][n]} THEN '{label}' END" for n, label in (('istitle', 'istitle'), ('isdigit', 'isdigit'), ('isupper', 'isupper'), ('hyphen', 'inhyphen'), ('isalnum', 'isalnum')))}], lambda x: x IS NOT NULL)) FROM nb" for p in POSITIONS]
    if detector == "az05":
        bag = "SELECT 'bow{0}-{1}', unnest(list(word) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx ROWS BETWEEN {2})) FROM tagged"
        union += [bag.format(-4, -1, "4 PRECEDING AND 1 PRECEDING"), bag.format(1, 4, "1 FOLLOWING AND 4 FOLLOWING")]
    if detector == "rr09_brown" or detector.startswith(("en", "de")):
        parts.append(f"clusters AS (SELECT word, {bits} AS bits FROM (SELECT DISTINCT word FROM tagged) WHERE length(word) > 3)")
        union += [f"SELECT 'brown_{k}_{p}', left(bits, {k}) FROM nb JOIN clusters ON w_{p} = word" for p in POSITIONS for k in (4, 6, 10, 20)]
    if detector.startswith(("en", "de")):
        lists = ["place"] if detector.startswith("en") else ["place", "org"]
        union += [f"SELECT 'gaz_{x}_{p}', unnest(string_split(codes, '')) FROM nb JOIN gaz ON w_{p} = token" for x in lists for p in NEAR]
    words = f"firstnames AS (SELECT {title_words('n_name')} AS token FROM nation), lastnames AS (SELECT {title_words('r_name')} AS token FROM region)"
    tagged = "tagged AS (SELECT doc_id, sent_id, tok_idx, word, tag, right(word, 2) AS pos, CASE WHEN tag = 'O' THEN 'O' ELSE 'I-NP' END AS chunk FROM tokens)"
    return f"{gazetteer}, {tokens}, {tagged}, {words}, {window_sql(detector, 'tagged')}, {', '.join(parts)} SELECT ftype, count(*) AS n, sum(length(fval))::BIGINT AS chars FROM ({' UNION ALL '.join(union)}) u(ftype, fval) GROUP BY ftype"


# ---------------------------------------------------------------- learners: one step of a recursive query for each visit

ROWS = """v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, embedding::DOUBLE[] AS x, CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END AS y, label FROM embeddings WHERE embedding IS NOT NULL), size AS MATERIALIZED (SELECT count(*) AS n, max(len(x)) AS d FROM v)"""
ZERO = "list_transform(range(d), lambda i: 0.0::DOUBLE)"
WEIGHTS = "SELECT unnest(range(len(w)))::BIGINT AS fid, round(unnest(w), 6) + 0.0 AS w FROM e UNION ALL SELECT -1::BIGINT, round(b, 6) + 0.0 FROM e"
HUBER = "CASE WHEN z >= 1 THEN 0.0 WHEN z >= -1 THEN 2 * (1 - z) * y ELSE 4 * y END"


def first_rate(reg: float) -> float:
    """Of the modified Huber loss: a typical weight over its gradient there."""
    size = reg**-0.25
    return size / max(1.0, 2 * (1 + size) if size <= 1 else 4.0)


def sgd_sql(reg: float, epochs: int, elastic: float = 1.0) -> str:
    """Modified Huber loss with bias; elastic: the share of the squared penalty."""
    rate = f"(1.0 / ({reg}::DOUBLE * ({1 / (reg * first_rate(reg))!r}::DOUBLE + st.s)))"
    seen = f"SELECT st.*, x, y, y * (list_inner_product(w, x) + b) AS z, {rate} AS rate FROM st JOIN v ON v.k = st.s % (SELECT n FROM size) WHERE st.s < {epochs} * (SELECT n FROM size)"
    moved = f"SELECT s, x, b + 0.01 * rate * ({HUBER}) AS b, rate, due + rate * {(1 - elastic) * reg!r}::DOUBLE AS due, paid, list_transform(list_zip(w, x), lambda t: (t[1] + rate * ({HUBER}) * t[2]) * (1 - rate * {elastic * reg!r}::DOUBLE)) AS w FROM ({seen})"
    if elastic == 1:
        step = f"SELECT s + 1, w, b, due, paid FROM ({moved})"
    else:
        cut = "CASE WHEN t[3] = 0 OR t[1] = 0 THEN t[1] WHEN t[1] > 0 THEN greatest(0.0, t[1] - (due + t[2])) ELSE least(0.0, t[1] + (due - t[2])) END"
        step = f"SELECT s + 1, list_transform(list_zip(w, paid, x), lambda t: {cut}), b, due, list_transform(list_zip(w, paid, x), lambda t: t[2] + ({cut}) - t[1]) FROM ({moved})"
    return f"WITH RECURSIVE {ROWS}, st(s, w, b, due, paid) AS (SELECT 0::BIGINT, {ZERO}, 0.0::DOUBLE, 0.0::DOUBLE, {ZERO} FROM size UNION ALL {step}), e AS (SELECT w, b FROM st ORDER BY s DESC LIMIT 1) {WEIGHTS}"


def pegasos_sql(reg: float, epochs: int) -> str:
    seen = f"SELECT st.*, x, y, y * (list_inner_product(w, x) + b) AS z, 1.0 / ({reg}::DOUBLE * (st.s + 1)) AS rate FROM st JOIN v ON v.k = st.s % (SELECT n FROM size) WHERE st.s < {epochs} * (SELECT n FROM size)"
    moved = f"SELECT s, CASE WHEN z < 1 THEN b + 0.01 * rate * y ELSE b END AS b, list_transform(list_zip(w, x), lambda t: (t[1] + CASE WHEN z < 1 THEN rate * y ELSE 0 END * t[2]) * (1 - 1.0::DOUBLE / (s + 1))) AS w FROM ({seen})"
    drawn = f"SELECT s, b, w, least(1.0, {reg**-0.5!r}::DOUBLE / greatest(sqrt(list_inner_product(w, w)), 1e-300)) AS into_ball FROM ({moved})"
    return f"WITH RECURSIVE {ROWS}, st(s, w, b) AS (SELECT 0::BIGINT, {ZERO}, 0.0::DOUBLE FROM size UNION ALL SELECT s + 1, list_transform(w, lambda u: u * into_ball), b FROM ({drawn})), e AS (SELECT w, b FROM st ORDER BY s DESC LIMIT 1) {WEIGHTS}"


def perceptron_sql(classes: int, epochs: int) -> str:
    """(class_id, fid, w): averaged over the steps behind each update."""
    zero = f"list_transform(range({classes}), lambda c: {ZERO})"
    seen = f"SELECT st.*, x, label, list_transform(w, lambda c: list_inner_product(c, x)) AS z FROM st JOIN v ON v.k = st.s % (SELECT n FROM size) WHERE st.s < {epochs} * (SELECT n FROM size)"
    guess = f"SELECT *, {classes} - list_position(list_reverse(z), list_max(z)) AS guess FROM ({seen})"
    sign = "(CASE WHEN guess = label THEN 0 WHEN c[2] = label THEN 1 WHEN c[2] = guess THEN -1 ELSE 0 END)"
    step = f"SELECT s + 1, list_transform(list_zip(w, range({classes})), lambda c: list_transform(list_zip(c[1], x), lambda t: t[1] + {sign} * t[2])), list_transform(list_zip(early, range({classes})), lambda c: list_transform(list_zip(c[1], x), lambda t: t[1] + (s + 1) * {sign} * t[2])) FROM ({guess})"
    return f"""WITH RECURSIVE {ROWS}, st(s, w, early) AS (SELECT 0::BIGINT, {zero}, {zero} FROM size UNION ALL {step}), e AS (SELECT * FROM st ORDER BY s DESC LIMIT 1),
c AS (SELECT s, unnest(range({classes})) AS class_id, unnest(w) AS w, unnest(early) AS early FROM e) SELECT class_id::BIGINT AS class_id, unnest(range(len(w)))::BIGINT AS fid, round(unnest(list_transform(list_zip(w, early), lambda t: t[1] - t[2] / s)), 6) + 0.0 AS w FROM c"""


def maxent_sql(classes: int, reg: float, epochs: int, rates: tuple[float, ...], part: int) -> str:
    """(class_id, fid, w), fid -1 for the bias. The first rate is the one of ``rates`` with which a sweep over a part of the rows is likeliest."""
    zero, bias = f"list_transform(range({classes}), lambda c: {ZERO})", f"list_transform(range({classes}), lambda c: 0.0::DOUBLE)"

    def moved(state: str, keys: str, rows: str, end: str) -> str:
        """A step of a state (keys, t, s, w, b, ll), s visits after the first rate 1 / (reg t)."""
        seen = f"SELECT {state}.*, x, label, 1.0 / ({reg}::DOUBLE * (t + s)) AS rate, list_transform(list_zip(w, b), lambda c: list_inner_product(c[1], x) + c[2]) AS z FROM {state} JOIN {rows} r ON r.k = {state}.s % (SELECT count(*) FROM {rows}) WHERE {state}.s < {end}"
        shares = f"SELECT *, list_transform(z, lambda a: exp(a - list_max(z))) AS e FROM ({seen})"
        pulls = f"SELECT *, ln(greatest(e[label + 1] / list_sum(e), 1e-300)) AS gain, list_transform(list_zip(e, range({classes})), lambda c: rate * (CASE WHEN c[2] = label THEN 1 ELSE 0 END - c[1] / list_sum(e))) AS g FROM ({shares})"
        return f"SELECT {keys}t, s + 1, list_transform(list_zip(w, g), lambda c: list_transform(list_zip(c[1], x), lambda t: (t[1] + c[2] * t[2]) * (1 - rate * {reg}::DOUBLE))), list_transform(list_zip(b, g), lambda c: c[1] + 0.01 * c[2]), ll + gain FROM ({pulls})"

    tenth = f"tenth AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, x, label FROM (SELECT vec_id, embedding::DOUBLE[] AS x, label, row_number() OVER (ORDER BY md5(vec_id || ':0:0'), vec_id) AS place FROM embeddings WHERE embedding IS NOT NULL) WHERE place <= greatest(1, (SELECT n FROM size) // {part}))"
    tried = f"tried(i, t, s, w, b, ll) AS (SELECT i, 1 / ({reg}::DOUBLE * first), 0::BIGINT, {zero}, {bias}, 0.0::DOUBLE FROM size CROSS JOIN (SELECT unnest(range({len(rates)})) AS i, unnest({list(rates)!r})::DOUBLE AS first) UNION ALL {moved('tried', 'i, ', 'tenth', '(SELECT count(*) FROM tenth)')})"
    best = "best AS MATERIALIZED (SELECT t FROM tried WHERE s = (SELECT count(*) FROM tenth) ORDER BY ll DESC, i LIMIT 1)"
    st = f"st(t, s, w, b, ll) AS (SELECT t, 0::BIGINT, {zero}, {bias}, 0.0::DOUBLE FROM size CROSS JOIN best UNION ALL {moved('st', '', 'v', f'{epochs} * (SELECT n FROM size)')})"
    return f"""WITH RECURSIVE {ROWS}, {tenth}, {tried}, {best}, {st}, e AS (SELECT * FROM st ORDER BY s DESC LIMIT 1),
c AS (SELECT unnest(range({classes})) AS class_id, unnest(w) AS w, unnest(b) AS b FROM e) SELECT class_id::BIGINT AS class_id, unnest(range(len(w)))::BIGINT AS fid, round(unnest(w), 6) + 0.0 AS w FROM c UNION ALL SELECT class_id, -1, round(b, 6) + 0.0 FROM c"""


def one_vs_all_sql(reg: float, epochs: int) -> str:
    """(n, accuracy) of classifiers of one class against all on standardised rows of unit length, each with its bias."""
    rate = f"(1.0 / ({reg}::DOUBLE * ({1 / (reg * first_rate(reg))!r}::DOUBLE + st.s)))"
    flat = "flat AS (SELECT k, unnest(x) AS a, generate_subscripts(x, 1) AS dim FROM raw), moments AS (SELECT dim, avg(a) AS m, CASE WHEN stddev_pop(a) = 0 THEN 1 ELSE stddev_pop(a) END AS sd FROM flat GROUP BY dim)"
    rows = ROWS.replace("v AS MATERIALIZED", "raw AS MATERIALIZED").replace("FROM v)", "FROM raw)") + f", {flat}, scaled AS (SELECT k, list((a - m) / sd ORDER BY dim) AS x, any_value(label) AS label FROM flat JOIN moments USING (dim) JOIN raw USING (k) GROUP BY k), v AS MATERIALIZED (SELECT k, list_transform(x, lambda a: a / sqrt(list_inner_product(x, x))) AS x, label FROM scaled)"
    seen = f"SELECT st.*, x, CASE WHEN label = c THEN 1.0 ELSE -1.0 END AS y, list_inner_product(w, x) + b AS p, {rate} AS rate FROM st JOIN v ON v.k = st.s % (SELECT n FROM size) WHERE st.s < {epochs} * (SELECT n FROM size)"
    pulled = f"SELECT *, {HUBER} AS g FROM (SELECT *, p * y AS z FROM ({seen}))"
    step = f"SELECT c, s + 1, list_transform(list_zip(w, x), lambda t: (t[1] + rate * g * t[2]) * (1 - rate * {reg}::DOUBLE)), b + 0.01 * rate * g FROM ({pulled})"
    return f"""WITH RECURSIVE {rows}, st(c, s, w, b) AS (SELECT c, 0::BIGINT, {ZERO}, 0.0::DOUBLE FROM size CROSS JOIN (SELECT DISTINCT label AS c FROM raw) UNION ALL {step}), e AS (SELECT * FROM st WHERE s = (SELECT max(s) FROM st)),
p AS (SELECT label, c, row_number() OVER (PARTITION BY k ORDER BY round(list_inner_product(w, x) + b, 9) DESC, c DESC) AS r FROM v CROSS JOIN e) SELECT count(*) AS n, round(100.0 - 100.0 * avg((label <> c)::INT), 6) AS accuracy FROM p WHERE r = 1"""


def mixing_sql(parts: str, tasks: str, reg: float, blocks: int, elastic: float, bias: bool, out: str) -> str:
    """One round of parameter mixing from zero. parts: the tables normed (doc_id, fid, val) and kept (fid), the features.

    tasks: SELECT of doc_id, task, y, own: a row's sign for each task, and the feature that the task doesn't see, or -1.
    """
    rows = f"""dims AS MATERIALIZED (SELECT fid, row_number() OVER (ORDER BY fid) AS d FROM kept), cells AS (SELECT doc_id, d, val FROM normed JOIN dims USING (fid)), held AS (SELECT DISTINCT doc_id FROM cells),
dense AS MATERIALIZED (SELECT doc_id, list(coalesce(val, 0.0) ORDER BY d) AS x FROM held CROSS JOIN dims LEFT JOIN cells USING (doc_id, d) GROUP BY doc_id), signs AS MATERIALIZED ({tasks}),
dealt AS (SELECT *, h % {blocks} AS block FROM (SELECT doc_id, ('0x' || left(md5(doc_id || ':0:0'), 15))::BIGINT AS h FROM dense) WHERE doc_id IN (SELECT doc_id FROM signs)),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY h) - 1 AS k FROM dealt), sizes AS MATERIALIZED (SELECT block, count(*) AS n, sum(count(*)) OVER () AS every FROM placed GROUP BY block),
v AS MATERIALIZED (SELECT block, k, task, y, list_transform(list_zip(x, range(1, len(x) + 1)), lambda t: CASE WHEN t[2] = own THEN 0.0 ELSE t[1] END) AS x FROM placed JOIN dense USING (doc_id) JOIN signs USING (doc_id))"""
    first = repr(1 / (reg * first_rate(reg)))
    seen = f"SELECT st.*, x, y, y * (list_inner_product(w, x) + b) AS z, 1.0 / ({reg}::DOUBLE * ({first}::DOUBLE + st.s)) AS rate FROM st JOIN v ON v.block = st.block AND v.task = st.task AND v.k = st.s"
    moved = f"SELECT block, task, s, x, b + {0.01 if bias else 0.0} * rate * ({HUBER}) AS b, due + rate * {(1 - elastic) * reg!r}::DOUBLE AS due, paid, list_transform(list_zip(w, x), lambda t: (t[1] + rate * ({HUBER}) * t[2]) * (1 - rate * {elastic * reg!r}::DOUBLE)) AS w FROM ({seen})"
    cut = "CASE WHEN t[3] = 0 OR t[1] = 0 THEN t[1] WHEN t[1] > 0 THEN greatest(0.0, t[1] - (due + t[2])) ELSE least(0.0, t[1] + (due - t[2])) END"
    end = "CASE WHEN t[1] = 0 THEN 0.0 WHEN t[1] > 0 THEN greatest(0.0, t[1] - (due + t[2])) ELSE least(0.0, t[1] + (due - t[2])) END"
    if elastic == 1:
        step, settled = f"SELECT block, task, s + 1, w, b, due, paid FROM ({moved})", "w"
    else:
        step = f"SELECT block, task, s + 1, list_transform(list_zip(w, paid, x), lambda t: {cut}), b, due, list_transform(list_zip(w, paid, x), lambda t: t[2] + ({cut}) - t[1]) FROM ({moved})"
        settled = f"list_transform(list_zip(w, paid), lambda t: {end})"
    zero = "list_transform(range((SELECT count(*) FROM dims)), lambda i: 0.0::DOUBLE)"
    start = f"SELECT block, task, 0::BIGINT, {zero}, 0.0::DOUBLE, 0.0::DOUBLE, {zero} FROM sizes CROSS JOIN (SELECT DISTINCT task FROM signs)"
    each = f"ends AS (SELECT task, {settled} AS w, b, n::DOUBLE / every AS part FROM st JOIN sizes ON sizes.block = st.block AND st.s = n)"
    return f"""WITH RECURSIVE {parts}, {rows}, st(block, task, s, w, b, due, paid) AS ({start} UNION ALL {step}), {each},
flat AS (SELECT task, part * unnest(w) AS w, generate_subscripts(w, 1) AS d FROM ends), mixed AS (SELECT task, fid, sum(w) AS w FROM flat JOIN dims USING (d) GROUP BY task, fid UNION ALL SELECT task, -1, sum(part * b) FROM ends GROUP BY task) {out}"""
