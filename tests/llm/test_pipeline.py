import corpus_pipeline
from stratolog.llm import quality, toxicity
from test_copies import brute_near, long_rest
from test_texts import check_pieces, stats


def test_stages_agree_with_brute_force(spark, sf):
    """Each stage is judged on what the stage before it returned."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], sf).cache())
    assert all(r.columns == docs.columns for r in results[:-1])
    of = [{r.doc_id: r for r in d.collect()} for d in results[:-1]]
    scored = {r.doc_id: r.score for r in toxicity.score_texts(docs.select("doc_id", "text"), toxicity.model_for(spark, sf)).collect()}
    assert set(of[1]) == {d for d, s in scored.items() if s < toxicity.THRESHOLD}
    assert all(stats(r.text)[0] >= 50 for r in of[2].values()) and set(of[2]) == {r.doc_id for r in quality.quality_verdict(results[1]).filter("kept").collect()}
    groups = brute_near([(d, r.text) for d, r in of[2].items()])
    assert set(of[3]) == {d for d, (_, _, kept) in groups.items() if kept}
    left = long_rest([(d, r.text) for d, r in of[3].items()])
    for d, r in of[4].items():  # a character that is cut in part goes whole
        assert r.text == left[d].decode("utf-8", "ignore") and r.n_chars == len(r.text)
    from stratolog.llm.tokens import tokenizer
    import public_tokenizers

    library = tokenizer(public_tokenizers.path("word_bpe_49k.json")).library
    check_pieces(results[-1].collect(), {d: [*library.encode(r.text, add_special_tokens=False).ids, 1] for d, r in of[4].items()})
    final = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in final.collect())[0][0] == min(of[4])


def test_stages_begin_with_the_heap_given_back(spark, sf):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        before = sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
        stage(spark, docs, sf)
        assert sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()) > before


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns and n <= start.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
        docs.count()
