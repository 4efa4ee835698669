import random

import pytest

WORDS = "the of and to in is that for it was on with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", "x", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empties, white space only, long texts, near and exact copies, repeated rows."""
    rnd = random.Random(5)
    base = [prose(rnd, n) for n in (60, 120, 300, 80)]
    near = base[2].split()
    near[100] = "changed"
    texts = [None, "", " \n\t", "one", "One two", base[0], base[0], base[1], base[2], " ".join(near), base[3] * 60, "ÄÖ é ß 漢字 😀 x́", "line\nline\nline\n" + base[3], base[0]]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, base[1]), (None, "alone in the world")]


@pytest.fixture(scope="session")
def docs(spark, odd_docs):
    """Extra columns have names that operators use inside."""
    df = spark.createDataFrame([(i, t, "k", 1, "z") for i, t in odd_docs], "doc_id long, text string, kept string, shard int, _t string").selectExpr("*", "if(doc_id % 3 = 0, null, if(doc_id % 3 = 1, 'en', 'dé')) AS lang", "if(doc_id % 4 = 0, null, 'src') AS source", "length(text) + 0L AS n_chars").repartition(3)
    return df.persist()


@pytest.fixture(scope="session")
def tables(spark, docs, odd_docs, tmp_path_factory):
    """The same as a folder of tables, and one whose tables are empty."""
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i, _ in odd_docs if i is not None] + [(None, 1, 1), (5, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, odd_docs[9][1][60:400]), (1, None), (2, ""), (3, "one two"), (4, "nothing like this stands anywhere in these texts at all")], "item_id long, text string")
    odd = [None, "", "plain", "[INST] </s>", "[\\INST] [\\\\/INST] <", "漢字 😀\n[TURN]", "x" * 100_000]
    said = [(c, t, r, odd[(c or 0) * 3 % 7 if t is None else (t + (c or 0)) % 7]) for c in (0, 1, 2, 5, None) for t, r in ((0, "system"), (1, "user"), (2, "assistant"), (2, "assistant"), (3, None), (4, "to\nol[TURN]"), (None, "assistant"))]
    turns = spark.createDataFrame([(*x, "z") for x in [*said, said[1], said[2]]], "conv_id long, turn long, role string, text string, tree string").repartition(3)
    inf = float("inf")
    vectors = [[float((i * k) % 17 - i % 5) / 9 for k in range(6)] for i in range(40)]
    odd_vectors = [None, [], [1.0] * 5, [None, 1.0, 1.0, 1.0, 1.0, 1.0], [inf, 1.0, 1.0, 1.0, 1.0, 1.0], [-inf] * 6, [float("nan")] * 6, vectors[3], vectors[3]]
    embedded = [*((i, v) for i, v in enumerate(vectors)), (3, vectors[3]), *((100 + i, v) for i, v in enumerate(odd_vectors)), (None, vectors[4])]
    embeddings = spark.createDataFrame([(*x, "z") for x in embedded], "vec_id long, embedding array<float>, x string").repartition(3)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items), ("conversations", turns), ("embeddings", embeddings)):
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)
