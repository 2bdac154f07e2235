import corpus_pipeline
from test_quality import bad, good

from helixframe.llm import decontamination, near_texts
from helixframe.llm.queries import MODEL_PATH


def test_stages_take_effect(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    docs = [(i, good(i) + f" item {i} {i * 7} {i * 13} ends", "en", "s", 300) for i in range(400)] + [(1000 + i, bad(i), "en", "s", 300) for i in range(150)]
    passage = "a benchmark question that nobody should have seen before the day of the test itself"
    docs += [(2000, docs[3][1], "en", "s", 300), (2001, docs[3][1].lower(), "en", "s", 300), (2002, good(5000) + " " + passage.upper() + " " + good(5001), "en", "s", 300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 400), 0) for i, *_ in docs if i < 1100 and i % 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.keep_quality(spark, given, str(tmp_path))
    assert first.columns == given.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert sum(i in kept for i in range(400)) >= 398 and not any(1000 <= i < 1150 for i in kept)
    # Brute force of the other stages over what the first kept.
    sets = {i: set(near_texts.shingles(t)[0].tolist()) for i, t in kept.items()}
    lowest = {}
    for i in sorted(kept):
        near = [j for j in lowest if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        lowest[i] = min([lowest[j] for j in near], default=i)
    left = {i for i in kept if lowest[i] == i and decontamination.folded(passage) not in decontamination.folded(kept[i])}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == left and 2002 not in got and not {3, 2000} <= set(got)
    library = SentencePieceProcessor(model_file=MODEL_PATH)
    assert all(got[i] == [*library.encode(kept[i]), library.eos_id()] for i in left)


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding"]


def test_stages_take_nulls_empty_tables_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, accepted boolean, hits int, _cls string, ids int"
    passage = "a benchmark question that nobody should have seen before the day of the test itself"
    docs = [(i, good(i) + f" item {i} {i * 7} {i * 13} ends", "en", "s", 300, i % 2 == 0, 3, "c", 1) for i in range(60)]
    docs += [(100 + i, bad(i), "en", "s", 300, True, 0, None, None) for i in range(40)]
    docs += [(None, None, None, None, None, None, None, None, None), (200, "", None, None, None, None, None, None, None), (201, None, "en", "s", 0, None, None, None, None), (5, docs[5][1], "en", "s", 300, False, 3, "c", 1), (202, good(7) + " " + passage + " " + good(8), "en", "s", 300, None, None, None, None), (203, good(9) + " word" * 30_000, "en", "s", 300, None, None, None, None)]
    given = spark.createDataFrame(docs, schema)
    spark.createDataFrame([(i, int(i < 60), 0) for i, *_ in docs if i is not None and i < 140 and i % 3] + [(None, 1, None), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None), (None, "x y")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = str(tmp_path)
    kept = corpus_pipeline.keep_quality(spark, given, at)
    assert kept.columns == given.columns and sum(r.doc_id in range(60) and r.accepted in (True, False) for r in kept.collect()) >= 60
    single = corpus_pipeline.drop_near_duplicates(spark, given, at).collect()
    assert sorted(r.doc_id for r in single if r.doc_id in range(60)) == list(range(60)) and sum(not r.text for r in single) == 1
    clean = corpus_pipeline.drop_contaminated(spark, given, at)
    ids = [r.doc_id for r in clean.collect()]
    assert clean.columns == given.columns and 202 not in ids and len(ids) == len(docs) - 1
    encoded = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode_pieces(spark, given, at).collect()}
    assert encoded[None] == encoded[200] == encoded[201] == 1 and encoded[203] > 30_000
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.limit(0), at).count() == 0, name
    (tmp_path / "none").mkdir()
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{table}.parquet").limit(0).write.parquet(f"{at}/none/{table}.parquet")
    assert corpus_pipeline.keep_quality(spark, given, f"{at}/none").count() == len(docs) == corpus_pipeline.drop_contaminated(spark, given, f"{at}/none").count()
