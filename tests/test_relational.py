import random
import re
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import decomposition, lexicon, selection, sequence, stats, subspace, vocab
from glossa.sources import readers


def test_parse_bow(spark):
    rows = readers.parse_bow(spark.createDataFrame([("a:1 b:c:2 :3 d:4 #label#:x",)], "line string")).first()
    assert rows.label == "x" and [(t.term, t.freq) for t in rows.terms] == [("a", 1), ("d", 4)]
    with pytest.raises(Exception, match="no label"):
        readers.parse_bow(spark.createDataFrame([("a:1",)], "line string")).collect()


def test_bow_file_and_limit(spark, tmp_path):
    (tmp_path / "f.txt").write_text("good:2 book:1 #label#:positive\nbad:1 #label#:negative\n")
    assert readers.read_bow(spark, str(tmp_path / "f.txt")).count() == 2
    assert [r.label for r in readers.read_bow(spark, str(tmp_path / "f.txt"), 1).collect()] == ["positive"]


def test_vocabulary_labels_and_norm(spark):
    bow = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "a", 1), (2, "b", 1), (3, "c", 1)], "doc_id long, term string, freq long")
    df = vocab.document_frequency(bow)
    assert {r.term for r in df.collect()} == {"a", "b"}
    both = vocab.disjoint_vocabularies(df, df)
    assert [(r.side, r.term, r.fid) for r in both.orderBy("fid").collect()] == [("s", "a", 0), ("s", "b", 1), ("t", "a", 2), ("t", "b", 3)]
    rows = vocab.l2_normalize(vocab.vectorize(bow, both.where("side = 's'"))).where("doc_id = 0").orderBy("fid").collect()
    assert [round(r.val, 6) for r in rows] == [0.447214, 0.894427]
    two = vocab.encode_labels(spark.createDataFrame([("neg",), ("pos",), ("pos",)], "label string"))
    assert sorted({(r.label, r.y) for r in two.collect()}) == [("neg", -1), ("pos", 1)]
    three = vocab.encode_labels(spark.createDataFrame([("b",), ("a",), ("c",)], "label string"))
    assert sorted((r.label, r.y) for r in three.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_mutual_information_with_an_empty_cell(spark):
    terms = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (2, "b"), (3, "c")], "doc_id long, term string")
    ex = spark.createDataFrame([(0, 1), (1, 1), (2, -1), (3, -1)], "doc_id long, y int")
    mi = {r.term: r.mi for r in stats.mutual_information(stats.contingency(terms, ex)).collect()}
    assert {k: round(v, 6) for k, v in mi.items()} == {"a": 1.04411, "b": 0.584963, "c": 0.666667}


def test_round_robin(spark):
    ranked = spark.createDataFrame([(c, i + 1, x) for c, s in enumerate(("ABC", "D", "EF")) for i, x in enumerate(s)], "class int, rank int, fid string")
    assert "".join(r.fid for r in selection.round_robin(ranked).collect()) == "ADEBFC"


def test_multiclass_equals_binary_rankings(spark):
    rnd = random.Random(0)
    f = spark.createDataFrame([(d, t) for d in range(30) for t in set(rnd.choices(range(12), k=4))], "doc_id long, fid long")
    ex = spark.createDataFrame([(d, "abc"[d % 3]) for d in range(30)], "doc_id long, label string")
    got = [r.fid for r in selection.mi_multiclass(f, ex, ["a", "b", "c"]).collect()]
    lists = [[r.fid for r in b.orderBy(F.desc(F.round("mi", 9)), "fid").collect()] for b in selection.binary_rankings(f, ex, ["a", "b", "c"]).values()]
    want = []
    for k in range(12):
        for x in lists:
            if k < len(x) and x[k] not in want:
                want.append(x[k])
    assert got == want


def test_gazetteers(spark):
    def codes(entries, encoding):
        return {r.token: r.codes for r in lexicon.gazetteer(spark.createDataFrame([(e,) for e in entries], "entry string"), encoding).collect()}

    assert codes(["New York Times", "Paris", "Paris Hilton"], "bilou") == {"New": "B", "York": "I", "Times": "L", "Paris": "BU", "Hilton": "L"}
    assert codes(["John Smith", "Elton John"], "iob") == {"John": "BI", "Smith": "I", "Elton": "B"}
    t = spark.createDataFrame([("Paris",), ("x",)], "word string")
    g = lexicon.gazetteer(spark.createDataFrame([("Paris",), ("Paris Hilton",)], "entry string"), "bilou")
    assert sorted(r.fval for r in lexicon.gazetteer_features(t, g, "gaz").collect()) == ["B", "U"]
    known = lexicon.member(t, lexicon.simple_gazetteer(spark.createDataFrame([("PARIS",)], "entry string"), False), case_sensitive=False)
    assert {r.word: r.known for r in known.collect()} == {"Paris": True, "x": False}


def test_brown_and_dictionary(spark):
    c = spark.createDataFrame([("Wien", "110101")], "token string, bits string")
    got = lexicon.brown_features(spark.createDataFrame([("Wien",), ("x",)], "word string"), c).collect()
    assert [(r.ftype, r.fval) for r in got] == [("brown_4_cur", "1101"), ("brown_6_cur", "110101"), ("brown_10_cur", "110101"), ("brown_20_cur", "110101")]
    pairs = readers.last_wins(spark.createDataFrame([(0, "x", "Foo bar"), (1, "x", "Baz")], "line_no long, ws string, wt string"), "ws", "wt")
    tr = lexicon.translate(pairs, spark.createDataFrame([("x", 3)], "term string, fid long"), spark.createDataFrame([("baz", 9)], "term string, fid long")).collect()
    assert [(r.fid_s, r.fid_t) for r in tr] == [(3, 9)]


def test_masks_blocks_tasks(spark):
    v = spark.createDataFrame([(0, "bword_pre_cur=a/b"), (1, "uword_cur=x")], "fid long, fname string")
    assert [r.fid for r in selection.location_mask(v, "pre").collect()] == [0]
    b = selection.feature_type_blocks(spark.createDataFrame([(0, "a=1"), (1, "a=2"), (2, "b=1")], "fid long, fname string")).orderBy("f_min").collect()
    assert [(r.ftype, r.f_min, r.f_max, r.contiguous) for r in b] == [("a", 0, 1, True), ("b", 2, 2, True)]


def test_projection_statistics_views(spark):
    f = spark.createDataFrame([(7, 1, 0.5), (7, 2, 2.0)], "doc_id long, fid long, val double")
    theta = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "fid long, vec array<double>")
    blocks = spark.createDataFrame([(0, 0, 1), (1, 2, 2)], "block_id int, f_min long, f_max long")
    assert [r.v for r in subspace.project(f, theta, blocks).orderBy("dim").collect()] == [1.0, 6.0]
    dense = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0])], "doc_id long, vec array<double>")
    table = stats.column_stats(dense)
    assert [(r.mean, r["std"]) for r in table.orderBy("dim").collect()] == [(2.0, 1.0), (5.0, 1.0)]
    assert [r.vec for r in stats.standardize(dense, table).orderBy("doc_id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    a, b = (spark.createDataFrame([(0, k, 1.0)], "doc_id long, fid long, val double") for k in (0, 1))
    assert sorted(r.fid for r in vocab.concat_views(a, b, 3).collect()) == [0, 4]
    with pytest.raises(ValueError, match="rows"):
        vocab.concat_views(a, b.limit(0), 3)


def test_svd_against_numpy(spark):
    rnd = np.random.default_rng(0)
    m = rnd.normal(size=(40, 6)) * (rnd.random((40, 6)) < 0.5)
    w = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "fid long, task_id long, w double")
    theta, (spectrum,) = decomposition.truncated_svd(spark, w, 4)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(spectrum, s[:4])
    got = {r.fid: r.vec for r in theta.collect()}
    for k in range(4):
        v = u[:, k] * np.sign(u[np.abs(u[:, k]).argmax(), k])
        assert np.allclose([got[i][k] if i in got else 0 for i in range(40)], v, atol=1e-6)


CONLL = "-DOCSTART- -X- O O\n\nPeter NNP I-NP B-PER\nBlackburn NNP I-NP I-PER\nsaw VBD I-VP O\nWien NNP I-NP B-LOC\n\n-DOCSTART- -X- O O\n\nx NN O O"


def test_conll(spark, tmp_path):
    (tmp_path / "f.txt").write_text(CONLL)
    t = readers.read_conll(spark, str(tmp_path / "f.txt"))
    rows = t.orderBy("doc_id", "sent_id", "tok_idx").collect()
    assert [(r.doc_id, r.word, r.tag) for r in rows] == [(0, "Peter", "B-PER"), (0, "Blackburn", "I-PER"), (0, "saw", "O"), (0, "Wien", "B-LOC"), (1, "x", "O")]
    assert [r.phrase for r in sequence.entities(t).orderBy("doc_id", "start").collect()] == ["Peter Blackburn", "Wien"]
    assert {r.tag for r in readers.read_conll(spark, str(tmp_path / "f.txt"), tags=("LOC",)).collect()} == {"O", "B-LOC"}
    assert {r.tag for r in readers.read_conll(spark, str(tmp_path / "f.txt"), iob=False).collect()} == {"O", "LOC", "PER"}
    assert {r.tag for r in readers.read_conll(spark, str(tmp_path / "f.txt"), raw=True).collect()} == {"Unk"}
    assert readers.documents(t).orderBy("doc_id").first().words == ["<s>", "Peter", "Blackburn", "saw", "Wien", "</s>"]
    with pytest.raises(ValueError, match="layout"):
        readers.read_conll(spark, str(tmp_path / "f.txt"), "fr")


def test_history_is_the_queue(spark):
    rnd = random.Random(1)
    toks = [(i // 50, (i // 10) % 5, i % 10, rnd.choice("xyzw"), rnd.choice(["O", "PER", "LOC"])) for i in range(400)]
    df = spark.createDataFrame(toks, "doc_id long, sent_id long, tok_idx int, word string, tag string")
    got = {(r.doc_id, r.sent_id, r.tok_idx): (r.eph_PER, r.eph_LOC) for r in sequence.extended_history(df, ["PER", "LOC"], 25).collect()}
    queue: deque = deque(maxlen=25)
    own = sequence.History(25)
    for d, s, k, w, tag in toks:
        want = tuple(sum(a == w and b == t for a, b in queue) for t in ("PER", "LOC"))
        assert got[(d, s, k)] == want and tuple(own.get(w).get(t, 0) for t in ("PER", "LOC")) == want
        own.push(w, tag)
        if tag != "O":
            queue.append((w, tag))


def test_chunk_scores(spark):
    t = spark.createDataFrame([(0, 0, 0, "a", "B-X", "B-X"), (0, 0, 1, "b", "I-X", "O"), (0, 0, 2, "c", "O", "O"), (0, 0, 3, "d", "B-Y", "B-Y")], "doc_id long, sent_id long, tok_idx int, word string, tag string, pred string")
    got = {r.type: (r.gold, r.found, r.correct) for r in sequence.chunk_scores(t).collect()}
    assert got == {"X": (1, 1, 0), "Y": (1, 1, 1), "ALL": (2, 2, 1)}
    assert sequence.accuracy(t).first().accuracy == 75


def test_model_folder(spark, tmp_path):
    w = spark.createDataFrame([(0, "f=a", 1.5)], "class_id long, fname string, w double")
    readers.save_model({"weights": w}, str(tmp_path / "m"), {"detector": "zj03"})
    tables, facts = readers.load_model(spark, str(tmp_path / "m"))
    assert facts == {"detector": "zj03"} and tables["weights"].first().w == 1.5


def test_history_is_a_queue_over_ranges(spark):
    """Against a queue fed token by token; ranges of 7 entities, so that words are dealt out several times."""
    import random

    from glossa.operators import sequence

    rnd = random.Random(3)
    t = [(d, s, k, rnd.choice("abcd"), rnd.choice(["O", "O", "B-X", "I-X", "Unk"])) for d in range(6) for s in range(3) for k in range(5)]
    q, want = sequence.History(5), {}
    for d, s, k, w, g in t:
        want[d, s, k] = (q.get(w).get("B-X", 0), q.get(w).get("I-X", 0), 0)
        q.push(w, g)
    df = spark.createDataFrame(t, "doc_id long, sent_id long, tok_idx int, word string, tag string").repartition(4)
    got = sequence.extended_history(df, ["B-X", "I-X", "O"], 5, 7).collect()
    assert {(r.doc_id, r.sent_id, r.tok_idx): (r["eph_B-X"], r["eph_I-X"], r["eph_O"]) for r in got} == want and len(got) == len(t)


def test_decoding_by_ranges_is_decoding_in_one_task(spark):
    """Weights that make a tag depend on the word's earlier tags, so that a wrong history would show far behind."""
    rnd = random.Random(8)
    toks = [(d, s, k, rnd.choice("abcdefgh"), "Unk") for d in range(60) for s in range(2) for k in range(6)]
    t = spark.createDataFrame(toks, "doc_id long, sent_id long, tok_idx int, word string, tag string").repartition(3)
    tags = ["O", "X", "Y"]
    weights = {(c, f"w={w}"): rnd.uniform(-1, 1) for c in range(3) for w in "abcdefgh"}
    weights |= {(c, f"eph={a}"): rnd.uniform(-0.6, 0.6) for c in range(3) for a in tags[1:]} | {(c, f"pre_tag={a}"): rnd.uniform(-0.5, 0.5) for c in range(3) for a in tags}
    rows = t.select("doc_id", "sent_id", "tok_idx", F.concat(F.lit("w="), "word").alias("fname"), F.lit(1.0).alias("val"))
    q, want, given = sequence.History(20), {}, []
    for d, s, k, w, _ in toks:
        given = given if k else []
        score = [weights[c, f"w={w}"] + (weights[c, f"pre_tag={given[-1]}"] if given else 0) + sum(weights.get((c, f"eph={a}"), 0) * n for a, n in q.get(w).items()) for c in range(3)]
        best = max(range(3), key=lambda c: (score[c], c))
        given.append(tags[best])
        q.push(w, tags[best])
        want[d, s, k] = tags[best]
    assert len(set(want.values())) > 1
    for size in (10_000, 100, 15):
        got = sequence.greedy_tags(t, rows, weights, tags, "zj03", True, "corpus", size, 20).collect()
        assert {(r.doc_id, r.sent_id, r.tok_idx): r.pred for r in got} == want and len(got) == len(toks)
    assert sequence.greedy_tags(t.limit(0), rows, weights, tags, "zj03", True, "corpus").count() == 0


def test_a_range_with_another_history_is_decoded_again_over_its_head_only(spark, monkeypatch):
    """The rounds write what they change, not all rows of all ranges once more."""
    from glossa import catalog

    one, write, rows = sequence.greedy_tags, sequence.written, {}

    def counted(spark, df, name):
        out = write(spark, df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(sequence, "written", counted)
    monkeypatch.setattr(sequence, "greedy_tags", lambda *a: one(*a, range_tokens=12_000, capacity=20))
    n = sum(r.n for r in catalog.corpus_decoding(spark, "/root/testdata/sf0.001").collect())
    assert rows["decoded"] and sum(rows["decoded"]) < n / 10


def test_positions_share_their_contexts(spark):
    """A word is one context for all positions that it stands in, a pair one for both of its templates; the counts stay those of the features."""
    from glossa.operators import templates

    t = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate("abcabc")] + [(2, 0, 0, "</s>"), (2, 0, 1, "a")], "doc_id long, sent_id long, tok_idx int, word string")
    wanted = lambda n: n.startswith(("uword", "bword"))
    found = templates.contexts(t, "rr09_aso", wanted=wanted)
    # a, b, c and both edges; the pairs of these, of which the second sentence has two more and an edge behind a
    assert found.distinct().count() == 5 + 8
    count = lambda df, n: sorted(map(tuple, df.groupBy("ftype", "fval").agg(n).collect()))
    assert count(found.counts(), F.sum("n")) == count(templates.features(t, "rr09_aso", wanted=wanted), F.count("*"))


def test_corpus_decoding(spark, monkeypatch):
    """The query against a plain loop; with small ranges the same."""
    from glossa import catalog

    sf, tags = "/root/testdata/sf0.001", ["O", "B-CAP", "I-CAP"]
    q, want, last = sequence.History(), {}, None
    for r in catalog.tokens(spark, sf).orderBy("doc_id", "sent_id", "tok_idx").collect():
        before = before if last == (r.doc_id, r.sent_id) else "<s>"  # noqa: F821
        last = (r.doc_id, r.sent_id)
        title = re.fullmatch("[A-Z][a-z]+", r.word) is not None
        score = [sum(catalog.DECODING.get((c, f), 0) * n for f, n in [("form=title" if title else "form=other", 1), (f"pre_tag={before}", 1), *((f"eph={a}", n) for a, n in q.get(r.word).items())]) for c in range(3)]
        before = tags[max(range(3), key=lambda c: (score[c], c))]
        q.push(r.word, before)
        n, b, i = want.get(r.doc_id, (0, 0, 0))
        want[r.doc_id] = (n + 1, b + (before == "B-CAP"), i + (before == "I-CAP"))
    one = sequence.greedy_tags
    monkeypatch.setattr(sequence, "greedy_tags", lambda *a: one(*a, range_tokens=12_000))
    assert {r.doc_id: (r.n, r.b, r.i) for r in catalog.corpus_decoding(spark, sf).collect()} == want
    assert sum(b for _, b, _ in want.values()) > 10


def test_running_history_of_the_corpus(spark, tmp_path):
    from glossa.streaming.history import running_history

    rows = [("a", "X", 0), ("b", "X", 1), ("a", "O", 2), ("a", "Y", 3), ("a", "X", 4), ("b", "Y", 5)]
    spark.createDataFrame(rows, "word string, tag string, at long").coalesce(1).write.parquet(f"{tmp_path}/in")
    want = {"corpus": ["", "", "X:1", "X:1", "Y:1", ""], "key": ["", "", "X:1", "X:1", "X:1,Y:1", "X:1"]}
    for scope, seen in want.items():
        stream = spark.readStream.schema("word string, tag string, at long").parquet(f"{tmp_path}/in")
        out = running_history(stream, 2, scope=scope).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{scope}-c")
        out.outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/{scope}").awaitTermination()
        assert [r.seen for r in spark.read.parquet(f"{tmp_path}/{scope}").orderBy("at").collect()] == seen


def test_biases_masks_lookups_and_samples(spark, tmp_path):
    from glossa.operators import lexicon, selection, subspace
    from glossa.sources import readers

    f = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 9, 1.0)], "doc_id long, fid long, val double")
    w = spark.createDataFrame([(0, 0, 2.0), (0, -1, -1.0), (1, 1, 1.0), (1, -1, 0.5)], "class_id long, fid long, w double")
    assert {r.doc_id: r.class_id for r in subspace.argmax_class(f, w).collect()} == {1: 0, 2: 1, 3: 1}
    tasks = f.withColumn("task_id", F.explode(F.array(F.lit(7), F.lit(8))))
    left = subspace.masked(tasks, spark.createDataFrame([(7, 0), (8, 1)], "task_id int, fid long"))
    assert {(r.task_id, r.fid) for r in left.collect()} == {(7, 1), (7, 9), (8, 0), (8, 9)}
    codes = lexicon.gazetteer(spark.createDataFrame([("New York",), ("york",)], "entry string"), "bilou", False)
    words = spark.createDataFrame([("York",), ("new",), ("x",)], "word string")
    assert {r.word: r.codes for r in lexicon.lookup(words, codes, case_sensitive=False).collect()} == {"York": "LU", "new": "B", "x": None} and lexicon.size(codes) == 2
    assert {r.word: r.codes for r in lexicon.lookup(words, codes).collect()}["York"] is None
    examples = spark.range(57).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id for r in selection.sample_probe(examples, seed).collect()} for seed in (0, 1))
    assert len(a) == len(b) == 5 and a != b
    (tmp_path / "clusters").write_text("0101\tWien\t12\nbad line\n0111\tRom\t3\n0000\tWien\t1\n")
    (tmp_path / "dict").write_text("good\tGut sein\nbad\tSchlecht\n\nodd\n")
    assert {r.token: r.bits for r in readers.read_clusters(spark, str(tmp_path / "clusters")).collect()} == {"Wien": "0000", "Rom": "0111"}
    assert {r.ws: r.wt for r in readers.read_dictionary(spark, str(tmp_path / "dict")).collect()} == {"good": "Gut sein", "bad": "Schlecht"}


@pytest.fixture
def narrow_splits(spark):
    """Splits of some kilobytes, and several in a task."""
    keys = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "100", "spark.sql.files.minPartitionNum": "2"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_of_files_beyond_a_split_keep_their_order(spark, tmp_path, narrow_splits):
    rnd = random.Random(1)
    folder, want = tmp_path / "files", []
    folder.mkdir()
    for name, n in (("a.txt", 7000), ("b.txt", 5000), ("c.txt", 3), ("d.txt", 0), ("e.txt", 9000)):
        lines = [f"{name} {i} " + "x" * rnd.randrange(12) if rnd.random() < 0.9 else "" for i in range(n)]
        (folder / name).write_text("".join(x + "\n" for x in lines))
        want += lines
    got = readers.numbered_lines(spark, str(folder))
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
    assert [(r.line_no, r.line) for r in got.orderBy("line_no").collect()] == list(enumerate(want))


def test_a_folder_reads_as_one_file(spark, tmp_path, narrow_splits):
    """Sentences, documents, and the last pair of a word, whatever the splits; blank lines and bytes beyond ASCII stay."""
    rnd = random.Random(2)
    parts = []
    for _ in range(4):
        rows = ["-DOCSTART- -X- O O", ""]
        for _ in range(600):
            rows += [f"{rnd.choice(['Käse', 'ein', 'Haus'])}{i} NN O {rnd.choice(['O', 'B-LOC'])}" for i in range(rnd.randrange(1, 9))] + [""]
        parts.append("\n".join(rows) + "\n")
    (tmp_path / "many").mkdir()
    for i, x in enumerate(parts):
        (tmp_path / "many" / f"{i}.conll").write_bytes(x.encode("iso-8859-1"))
    (tmp_path / "one").write_bytes("".join(parts).encode("iso-8859-1"))
    columns = "doc_id", "sent_id", "tok_idx", "word", "tag"
    many, one = (sorted(map(tuple, readers.read_conll(spark, str(tmp_path / x)).select(*columns).collect())) for x in ("many", "one"))
    assert many == one and {r[0] for r in many} == {0, 1, 2, 3} and any(r[3].startswith("Käse") for r in many)
    blocks = [b for x in parts for b in x.split("\n\n") if b.strip() and not b.startswith("-DOC")]
    assert len({r[1] for r in many}) == len(blocks) and len(many) == sum(len(b.strip().split("\n")) for b in blocks)
    (tmp_path / "pairs").mkdir()
    last = {}
    for i in range(3):
        pairs = [(f"w{rnd.randrange(900)}", f"t{i}-{k}") for k in range(4000)]
        last |= dict(pairs)
        (tmp_path / "pairs" / f"{i}").write_text("".join(f"{a}\t{b}\n" for a, b in pairs))
    assert {r.ws: r.wt for r in readers.read_dictionary(spark, str(tmp_path / "pairs")).collect()} == last


def test_running_totals(spark):
    df = spark.range(1000).selectExpr("id AS k", "id % 7 AS v").repartition(5)
    got = {r.k: r.s for r in vocab.running_totals(df, ["k"], "v", "s").collect()}
    assert got == {k: sum(i % 7 for i in range(k)) for k in range(1000)}
    assert vocab.running_totals(df.limit(0), ["k"], "v", "s").count() == 0
