"""What keeps work in proportion to the input: what is shuffled, written, and held."""

from pyspark.sql import functions as F

from glossa import catalog
from glossa.operators import lexicon, templates

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_not_shuffled(spark):
    for name in ("context_window", "sentences", "documents_marked"):
        text = plan(catalog.QUERIES[name](spark, DIR))
        assert text.count("Exchange") == 1, name
        assert text.rindex("Generate") < text.index("Exchange"), name  # texts are dealt, not their tokens


def test_only_what_is_read_of_a_word_goes_through_the_window(spark):
    t = templates.with_neighbours(catalog.tokens(spark, DIR), kind="num", read=("num", "title"))
    assert t.schema["@pre"].dataType.names == ["word", "num", "title"]


def test_counts_of_contexts_need_no_table_of_neighbours(spark, monkeypatch):
    rows = [(1, 0, i, w, "O") for i, w in enumerate(["Anna", "</s>", "Berta-Rosa", "12", "</s>"])] + [(1, 1, 0, "<s>", "O")]
    t = spark.createDataFrame(rows, "doc_id long, sent_id long, tok_idx int, word string, tag string")
    bits = spark.createDataFrame([("</s>", "0101010101010101010101"), ("Anna", "1111")], "token string, bits string")
    lex = {"brown": bits, "places": lexicon.gazetteer(spark.createDataFrame([("</s> Anna",)], "entry string")), "firstnames": lexicon.simple_gazetteer(spark.createDataFrame([("Anna",)], "entry string"))}
    names = []
    real = templates.written
    monkeypatch.setattr(templates, "written", lambda s, df, name: names.append(name) or real(s, df, name))
    got = templates.contexts(t, "en_best_v1", lex).counts().groupBy("ftype", "fval").agg(F.sum("n").alias("n"))
    want = templates.features(t, "en_best_v1", lex).groupBy("ftype", "fval").agg(F.count(F.lit(1)).alias("n"))
    # words that look like the marks beyond a sentence are known to lexicons, the marks aren't
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "neighbours" not in names


def test_learners_go_from_range_to_range(spark):
    import numpy as np

    from glossa.operators import linear

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).round(3)
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    features = spark.createDataFrame([(i * 7 % 60, j, float(x[i * 7 % 60, j])) for i in range(60) for j in range(5)], "doc_id long, fid long, val double")
    labels = spark.createDataFrame([(i, float(y[i]), float(i % 3)) for i in range(60)], "doc_id long, y0 double, y1 double")
    rows = linear.gather(features, 5)
    made = {0: linear.Descent(5, 1e-3, alpha=0.85), 1: linear.Perceptron(3, 5)}
    got = linear.in_order(spark, features, labels, made, 2, most=70)  # five ranges
    w, b = linear.sgd(rows, y, 1e-3, 2, norm="elastic", alpha=0.85, bias=True)
    assert np.array_equal(got[0].found()[0], w) and got[0].found()[1] == b
    assert np.array_equal(got[1].found()[0], linear.averaged_perceptron(rows, np.arange(60) % 3, 3, 2))


def test_terms_are_not_shuffled(spark):
    from glossa.operators import vocab

    docs = spark.createDataFrame([(1, "b A  a"), (2, ""), (1, "a c")], "doc_id long, text string")
    got = vocab.bag_of_words(docs)
    text = plan(got)
    assert text.count("Exchange") == 1 and text.rindex("Generate") < text.index("Exchange")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 3), (1, "b", 1), (1, "c", 1)]


def test_only_rows_of_rare_keys_are_shuffled(spark):
    from glossa.operators import vocab

    rows = spark.createDataFrame([(i, k) for i in range(40) for k in ("the", "of", f"w{i % 20}", f"x{i}") if k], "doc_id long, term string")
    df = vocab.document_frequency(rows)  # the, of: 40 each; w0 to w19: 2 each
    table = vocab.dense_ids(df, "term", "fid")
    want = sorted(map(tuple, rows.join(table.select("term", "fid"), "term").collect()))
    for counted in (table, table.drop("df")):
        for most in (0, 2, 5, 100):
            assert sorted(map(tuple, vocab.joined(rows, counted, "term", most).collect())) == want
    text = plan(vocab.joined(rows, table, "term", 5))
    assert text.count("BroadcastHashJoin") >= 2 and "LeftAnti" in text


def test_words_and_pairs_leave_their_sentence_once(spark):
    from glossa.operators import sequence

    texts = [["Anna", "12", "Anna", "12"], ["</s>"], ["<s>", "a/b", "c"], ["a", "b/c"], [], ["<s>", "Anna"], ["12", "</s>"], ["x1", "Anna", "12"]]
    lines = spark.createDataFrame([(0, i, ws) for i, ws in enumerate(texts)], "doc_id long, sent_id long, ws array<string>")
    t = lines.select("doc_id", "sent_id", F.posexplode("ws").alias("tok_idx", "word"))
    for least in (1, 2, 3):
        want = sequence.feature_vocabulary([(t, least)], "rr09_aso", wanted=lambda n: n.startswith(("uword_", "bword_")), counts=True)
        got = sequence.word_vocabulary(lines, least)
        assert sorted(map(tuple, got.select("fname", "n", "fid").collect())) == sorted(map(tuple, want.select("fname", "n", "fid").collect()))
    text = plan(catalog.word_vocab(spark, DIR))
    assert "Expand" not in text and "Window" not in text


def test_cross_language_query_keeps_the_whole_method(spark, monkeypatch):
    import inspect

    from glossa import catalog
    from glossa.plans import clscl

    asked = {}
    for name in ("train", "evaluate"):
        sig = inspect.signature(getattr(clscl, name))

        def noted(*args, _sig=sig, _name=name, **kw):
            bound = _sig.bind(*args, **kw)
            bound.apply_defaults()
            asked[_name] = bound.arguments

        monkeypatch.setattr(clscl, name, noted)
    catalog.clscl_accuracy(spark, "/root/testdata/sf0.001")
    assert {p: asked["train"][p] for p in ("m", "phi", "k", "visits")} == {"m": 450, "phi": 30, "k": 100, "visits": 1e6}
    assert {p: asked["evaluate"][p] for p in ("repetitions", "visits")} == {"repetitions": 10, "visits": 1e6}


def test_words_are_derived_once_for_all_positions(spark, monkeypatch):
    from glossa.operators import lexicon, templates

    rows = [(1, 0, i, w) for i, w in enumerate("Dr. Anna 0 false true </s> U-S 12 Ab-Cd".split())] + [(1, 1, 0, "0"), (2, 0, 0, "x.")]
    t = spark.createDataFrame(rows, "doc_id long, sent_id long, tok_idx int, word string")
    lex = {"brown": spark.createDataFrame([("Anna", "0"), ("x.", ""), ("</s>", "0101010101010101010101")], "token string, bits string"), "places": lexicon.gazetteer(spark.createDataFrame([("Anna 12",)], "entry string"))}
    looked, real = [], templates._with_lexicons
    monkeypatch.setattr(templates, "_with_lexicons", lambda base, own, *rest: looked.append(own) or real(base, own, *rest))
    found = templates.contexts(t, "de_best_v1", lex)
    counted = found.counts()
    assert len([own for own in looked if own]) == 1  # it was once for each position
    got = counted.groupBy("ftype", "fval").agg(F.sum("n").alias("n"))
    want = templates.features(t, "de_best_v1", lex).groupBy("ftype", "fval").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
