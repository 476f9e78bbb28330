from tidemark.queries import retrieval


def test_spans_are_grouped_once(spark):
    documents = retrieval.ocr_index_documents(spark, "/root/testdata/sf0.001")
    plan = documents._jdf.queryExecution().optimizedPlan().toString()
    # texts are grouped into spans before, and what is read here are the spans
    assert "struct(n," not in plan and "normalized_text" in plan
