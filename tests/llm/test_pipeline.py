import corpus_pipeline
from tessera.llm import quality
from tessera.llm.bpe import default_tokenizer
from tessera.llm.tables import read
from tests.llm.test_copies import brute_documents
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_secrets import brute as brute_secrets
from tests.llm.test_tokens import ids_of


def test_each_stage_decides_as_a_plain_version_does(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    labels = read(spark, sf_dir, "labels").filter(quality.remainder("doc_id", 4) != 2)
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, "quality"), ["doc_id"]).collect()}
    want = {d for d in rows if scores[d] >= 0.7}
    docs = stages["quality"](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in docs.collect()} == want and docs.columns == columns

    copies = brute_documents([(d, rows[d].text) for d in want])
    want = {d for d in want if copies[d][2]}
    docs = stages["near_copies"](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in docs.collect()} == want and docs.columns == columns

    contaminated = brute_contamination([(d, rows[d].text) for d in want], items)
    want = {d for d in want if not contaminated[d][4]}
    docs = stages["decontaminate"](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in docs.collect()} == want and docs.columns == columns

    docs = stages["secrets"](spark, docs, sf_dir).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(texts) == want and docs.columns == columns
    for d in want:
        assert texts[d] == rows[d].text or brute_secrets(rows[d].text)
        assert not brute_secrets(texts[d])

    packed = stages["packing"](spark, docs, sf_dir).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {d: len(ids_of(t, 0)) for d, t in texts.items()}
    assert default_tokenizer() and {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


def test_odd_rows_pass_through(spark, sf_dir):
    text = rows_text = read(spark, sf_dir, "documents").filter("doc_id = 1").first().text
    odd = spark.createDataFrame([(None, text, "en", "s", 1), (5, None, None, None, None), (6, "", "en", "s", 0), (7, text, "en", "s", 1), (7, text, "en", "s", 1), (8, rows_text + " x", "en", "s", 1)], read(spark, sf_dir, "documents").schema)
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns, name
    left = sorted(str(r.doc_id) for r in docs.collect())
    assert left == ["5", "6", "7", "7", "None"]
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_a_text_under_the_id_of_a_copy_is_not_lost(spark, sf_dir):
    schema = read(spark, sf_dir, "documents").schema
    rows = [(1, "a b c d e f g", "en", "s", 1), (5, "a b c d e f g", "en", "s", 1), (5, "one two three four five six", "en", "s", 1)]
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, spark.createDataFrame(rows, schema), sf_dir)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, rows[0][1]), (5, rows[2][1])]


def test_columns_named_like_results_pass_through(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").selectExpr("*", "1 AS score", "'s' AS scored_text", "2 AS sentences", "3 AS text_key", "4 AS row", "5 AS node", "6 AS gone_id").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        stage(spark, docs, sf_dir).collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 40


def test_a_clean_text_under_the_id_of_a_contaminated_one_stays(spark, sf_dir):
    item = read(spark, sf_dir, "benchmark").first().text
    rows = [(5, item, "en", "s", 1), (5, "a clean text of its own", "en", "s", 1)]
    kept = dict(corpus_pipeline.STAGES)["decontaminate"](spark, spark.createDataFrame(rows, read(spark, sf_dir, "documents").schema), sf_dir)
    assert [r.text for r in kept.collect()] == [rows[1][1]]


def test_lengths_of_any_type_pass_and_numbers_follow_the_text(spark, sf_dir):
    text = "password=abcdef123 and more"
    for kind, given, want in (("string", "many", "many"), ("long", 5, len("[assign] and more")), ("double", 1.5, 1.5), ("array<int>", [1], [1])):
        docs = spark.createDataFrame([(1, text, given), (2, "clean", given), (3, None, None)], f"doc_id long, text string, n_chars {kind}")
        got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["secrets"](spark, docs, sf_dir).collect()}
        assert "abcdef123" not in got[1].text and got[2].n_chars == given and got[3].n_chars is None
        assert got[1].n_chars == (len(got[1].text) if kind == "long" else want)
