import corpus_pipeline


def test_stages_on_odd_rows(spark, tables):
    from glossa.llm.common import staged, table

    for d in tables:
        docs = table(spark, d, "documents")
        for k, (name, f) in enumerate(corpus_pipeline.STAGES):
            out = staged(spark, f(spark, docs, d), name)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
            docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "pieces"]


def test_stages_decide_as_the_operators(spark, tables):
    from glossa.llm import decontaminate
    from glossa.llm.common import table

    d = tables[0]
    docs = table(spark, d, "documents")
    hit = {r.doc_id for r in decontaminate.matches(spark, docs.select("doc_id", "text"), table(spark, d, "benchmark")).collect()}
    left = {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, d).collect()}
    assert hit and not hit & left and {r.doc_id for r in docs.collect()} == hit | left
    last = corpus_pipeline.encode_pieces(spark, docs, d).collect()
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    assert all(r.decoded == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in last if r.doc_id is not None)
