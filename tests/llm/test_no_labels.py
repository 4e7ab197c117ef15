import corpus_pipeline


def test_without_labels_documents_without_a_letter_go(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "12 3", None), (3, None, None), (4, "é", None), (5, "", None)],
                                 "doc_id long, text string, lang string")
    found = corpus_pipeline.identify_language(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 4]
