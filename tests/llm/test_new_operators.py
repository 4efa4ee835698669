"""Whitening, chat formatting and the manifest against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import chat, merkle, whitening


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """All levels over a list of hashes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, p):
    out = []
    for nodes in levels[:-1]:
        run = p // 8 * 8
        out.append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 8])))
        p //= 8
    return out


def brute_manifest(docs):
    enc = lambda *v: "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v)
    by = defaultdict(list)
    for i, source, lang, n, text in docs:
        low = text if text is None else text.translate({c: c + 32 for c in range(65, 91)})
        leaf = sha(enc(i, source, lang, n, text))
        seen = sha(enc(i, source, lang, n, low)) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else leaf
        by[lang].append(((i is not None, i or 0), leaf, seen, i))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: climb([x[1] for x in sorted(by[k])]) for k in langs}
    top = climb([trees[k][-1][0] for k in langs])
    out = []
    for q, k in enumerate(langs):
        for p, (_, leaf, seen, i) in enumerate(sorted(by[k])):
            steps = siblings(trees[k], p) + siblings(top, q)
            for left, right in steps:
                seen = sha(left + seen + right)
            out.append((i, leaf, trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), seen, seen == top[-1][0]))
    return Counter(out)


FACTS = "doc_id", "source", "lang", "n_chars", "text"


def test_manifest_of_odd_rows(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(tables[0] + "/documents.parquet").select(*FACTS).collect()]
    assert Counter(map(tuple, merkle.op13(spark, tables[0]).collect())) == brute_manifest(docs)


@pytest.mark.parametrize("sizes", [(1,), (8, 1), (9, 64, 65), (513, 2)])
def test_manifest_of_sizes_about_a_level(spark, tmp_path, sizes):
    docs = [(100 * k + i, "s", f"l{k}", i, f"T {i}") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, merkle.op13(spark, str(tmp_path)).collect())) == brute_manifest(docs)


def test_manifest_of_many_keys_and_one_large_one(spark, tmp_path):
    """Three rounds of blocks in the large key, two in the tree of keys."""
    n = (1 << 18) + 3
    docs = spark.range(n + 700).selectExpr("id AS doc_id", "'s' AS source", f"if(id < {n}, 'large', cast(id AS string)) AS lang", "id AS n_chars", "concat('Text ', id) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13(spark, str(tmp_path)).agg(F.count("*"), F.count_distinct("root"), F.count_distinct("subroot"), F.sum(F.col("verified").cast("int"))).first()
    assert tuple(got) == (n + 700, 1, 701, sum(zlib.crc32(str(i).encode()) % 3 != 0 for i in range(n + 700)))


def test_manifest_and_chat_are_their_sql(spark, tables):
    import duckdb

    for query, sql, name, facts in ((merkle.op13, merkle.ORACLE, "documents", FACTS), (chat.op12, chat.ORACLE, "conversations", ("conv_id", "turn", "role", "text"))):
        for folder in (tables[0], "/root/testdata/sf0.001"):
            c = duckdb.connect()
            c.execute(f"CREATE VIEW {name} AS SELECT {', '.join(facts)} FROM read_parquet('{folder}/{name}.parquet{'' if folder.endswith('001') else '/*.parquet'}')")
            columns = sorted(x[0] for x in c.execute(sql).description)
            if name == "conversations" and folder == tables[0]:  # its equal turns go by a hash, which SQL hasn't got
                columns = ["conv_id", "formatted_chars", "loss_chars", "n_turns"]
            got = query(spark, folder).select(*columns).collect()
            assert Counter(map(tuple, got)) == Counter(c.execute(f"SELECT {', '.join(columns)} FROM ({sql}) q").fetchall())


CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]")


def test_template_is_read_back(spark):
    """Any text, made of control strings, parts of them and backslashes, comes back; marks stand nowhere inside a text."""
    rnd = random.Random(3)
    parts = [*CONTROLS, "<", "[", "\\", "]", "s>", "INST]", "/", "a", " ", "\n", "😀", ""]
    text = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))
    said = [[(rnd.choice(["user", "assistant", "system", "", text()]), text()) for _ in range(rnd.randrange(1, 7))] for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id int, turns array<struct<role:string,text:string>>")
    whole, mask = chat.formatted("turns")
    out = df.select("id", whole.alias("c"), mask.alias("mask")).withColumn("parts", chat.read_turns("c"))
    for r in out.select("id", "c", "mask", F.transform("parts", chat.read_turn).alias("back"), chat.learned_text("parts", "mask").alias("learned")).collect():
        assert [tuple(t) for t in r.back] == said[r.id]
        assert r.learned == "".join(t for role, t in said[r.id] if role == "assistant")
        for m in r.mask:
            assert not any(c in r.c[m.start : m.end] for c in CONTROLS)
            assert r.c[: m.start].count("</s>") == sum(role == "assistant" for role, _ in said[r.id][: m.turn])


def test_reply_trees(spark):
    """Branches by plain recursion: random trees, one of them a long chain, with ties and odd ids."""
    rnd = random.Random(7)
    rows = [(0, 0, None, "user", "r0", 0.0)]
    rows += [(0, i, i - 1, "assistant" if i % 2 else "user", f"c{i}", 1.0) for i in range(1, 70)]
    for tree in range(1, 12):
        for i in range(rnd.randrange(1, 25)):
            rows.append((tree, 100 * tree + i, None if i == 0 else 100 * tree + rnd.randrange(i), rnd.choice(["user", "assistant"]), f"m{tree}-{i}", rnd.choice([None, 0.0, 1.0, 2.0])))
    rows += [(20, None, 999, "user", "no id", 3.0), (20, 2000, 12345, None, None, None), (None, 2001, None, "user", "no tree", 1.0)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "tree long, id long, parent long, role string, text string, score double, row string").repartition(3)
    ids = {r[1]: r for r in rows if r[1] is not None}
    parents = {r[2] for r in rows}
    want = defaultdict(list)
    for r in rows:
        if r[1] is None or r[1] not in parents:
            path = [r]
            while path[0][2] in ids and path[0][2] is not None:
                path.insert(0, ids[path[0][2]])
            want[r[0]].append((-sum(x[5] or 0 for x in path) / len(path), r[1] is not None, r[1] or 0, path))
    for best in (1, 2, None):
        got = {(r.tree, r.branch): r for r in chat.conversations(spark, df, best).collect()}
        chosen = {(t, k): b for t, bs in want.items() for k, b in enumerate(sorted(bs, key=lambda x: x[:3])[:best])}
        assert got.keys() == chosen.keys()
        for key, (score, *_, path) in chosen.items():
            assert got[key].n_turns == len(path) and abs(got[key].score + score) < 1e-12
            text = "<s>" + "".join({"user": f"[INST] {x[4]} [/INST]", "assistant": f" {x[4]}</s>", None: "[TURN][TURN][/TURN]"}[x[3]] for x in path)
            assert got[key].conversation == text
    with pytest.raises(ValueError, match="cycle"):
        chat.conversations(spark, spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], "tree long, id long, parent long, role string, text string, score double"))


def test_chat_of_odd_rows(spark, tables):
    given = defaultdict(list)
    for r in spark.read.parquet(tables[0] + "/conversations.parquet").collect():
        given[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.op12(spark, tables[0]).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got.keys() == given.keys() | {-7}
    assert got[-7].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-7].loss_sha256 == sha(said) and got[-7].loss_chars == len(said)
    for c, turns in given.items():
        assert got[c].n_turns == len(turns) and got[c].loss_chars == sum(len(t[3]) for t in turns if t[2] == "assistant")
        if len(set(t[:3] for t in turns)) == len(set(turns)):
            assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in sorted(turns)))
            assert got[c].loss_sha256 == sha("".join(t for _, _, r, t in sorted(turns) if r == "assistant"))


@pytest.mark.parametrize(("d", "k"), [(6, 32), (64, 32), (220, 32), (150, 1)])
def test_lobpcg_is_the_dense_solution(d, k):
    b = np.random.default_rng(d).standard_normal((2000, d)) * np.linspace(1, 3, d)
    v = b.T @ b / 2000
    e, u = whitening.lobpcg(lambda q: v @ q, d, k)
    want, w = np.linalg.eigh(v)
    want, w = want[::-1][:k], w[:, ::-1][:, :k]
    assert np.abs(e - want).max() < 1e-13 * want[0] * d and np.abs(np.abs((u * w).sum(0)) - 1).max() < 1e-12
    assert np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-10 * want[0]


def test_lobpcg_of_odd_spectra():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((180, 180)))[0]
    for values in (np.ones(180), np.r_[np.ones(100), np.zeros(80)], np.r_[5.0, np.zeros(179)], np.r_[np.full(40, 2.0), np.linspace(1, 0, 140)], np.geomspace(1, 1e-12, 180)):
        v = (q * values) @ q.T
        e, u = whitening.lobpcg(lambda b, v=v: v @ b, 180, 32)
        assert np.abs(e - values[:32]).max() < 1e-11 and np.abs(u.T @ u - np.eye(32)).max() < 1e-11


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    kept = e > 1e-9 * e[0]
    return x, (c @ u / np.sqrt(np.where(kept, e, 1)))[:, kept][:, :32], (e / e.sum())[kept][:32], ((n * x - s) ** 2).sum(1)


def test_whitening_of_odd_rows_is_the_dense_version(spark, tables):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(tables[0] + "/embeddings.parquet").collect()]
    kept = [(i, v) for i, v in given if v and len(v) == 6 and all(y is not None and np.isfinite(y) for y in v)]
    x, w, share, deviation = plain_whitening([v for _, v in kept])
    got = whitening.op11(spark, tables[0]).toPandas()
    assert len(got) == w.size and (got.n == len(x)).all() and got.identity_error.max() < 1e-10
    assert Counter(got[got.component == 1].vec_id.fillna(-1)) == Counter(-1 if i is None else i for i, _ in kept)
    dev = {(-1 if i is None else i): int(y) for (i, _), y in zip(kept, deviation, strict=True)}
    for c in range(w.shape[1]):
        mine = got[got.component == c + 1]
        ids = mine.vec_id.fillna(-1).astype(int)
        assert mine.deviation.tolist() == [dev[i] for i in ids] and np.allclose(mine.explained, share[c], rtol=1e-10)
        plain = {(-1 if i is None else i): y for (i, _), y in zip(kept, w[:, c], strict=True)}
        y = np.array([plain[i] for i in ids])
        assert min(np.abs(mine.whitened - y).max(), np.abs(mine.whitened + y).max()) < 1e-9


def test_whitening_of_large_vectors(spark):
    """More dimensions than the basis has columns, so that the directions before are of use."""
    rng = np.random.default_rng(2)
    data = (rng.standard_normal((600, 160)) * np.linspace(0.2, 2, 160)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(5)
    rows, d = whitening.prepare(spark, df)
    model = whitening.learn(rows, d)
    got = whitening.whitened(rows, d, model, whitening.identity_error(rows, d, model)).toPandas().sort_values(["vec_id", "component"])
    _, w, _, _ = plain_whitening(data)
    mine = got.whitened.to_numpy().reshape(600, 32)
    assert d == 160 and got.identity_error.max() < 1e-9 and np.abs(mine * np.sign((mine * w).sum(0)) - w).max() < 1e-8


def test_whitening_without_variance(spark):
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])], [(1, None)]):
        table, d = whitening.prepare(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert whitening.learn(table, d) is None


def test_deviations_beyond_a_long():
    fit = whitening.Fit(3, np.array([0, 0]), np.array([0, 1]))
    assert whitening.deviations(np.array([[1, 2]]), fit) == [9 + 25]
    assert whitening.deviations(np.array([[1 << 40, 0], [1 << 29, 1]]), fit) == [None, (3 << 29) ** 2 + 4]
