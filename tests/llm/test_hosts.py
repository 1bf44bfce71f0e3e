"""Hosts most of whose documents fail, at the values the pipeline uses."""

from conftest import DATA

import corpus_pipeline


def test_the_pipeline_rejects_hosts_most_of_whose_documents_fail(spark):
    good = " ".join(f"word{i}" for i in range(300))
    symbols = good + " #" * 20 + "".join(f"\nline {i} is longer\nline {i} is longer" for i in range(12))
    rows = [(i, good, f"h{i % 20}") for i in range(400)]
    rows += [(1000 + i, symbols if i % 5 else good, "symbols") for i in range(50)]
    rows += [(2000 + i, "# " * 10 if i % 5 else good, "short") for i in range(50)]
    rows += [(3000 + i, symbols if i % 5 < 2 else good, "some") for i in range(50)]
    rows += [(5000, symbols, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    left = {r.source for r in corpus_pipeline.quality(spark, docs, DATA).collect()}
    assert left == {f"h{i}" for i in range(20)} | {"some", None}


def test_a_host_is_not_rejected_for_one_document(spark):
    good, bad = (" ".join(f"word{i}" for i in range(300)) + tail for tail in ("", " # * $ %" * 20))
    rows = [(i, bad if i % 20 < 3 + i // 20 % 3 else good, f"h{i // 20}") for i in range(400)]
    rows += [(1000 + i, bad if i % 5 == 0 else good, f"one{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert corpus_pipeline.quality(spark, docs, DATA).count() == 600
