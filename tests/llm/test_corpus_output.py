"""What the pipeline's last stage gives out."""

import tiktoken
from conftest import DATA
from public_tokenizers import PATTERN

import corpus_pipeline
from tidemill.llm.bpe import bpe_round_trip, read_ranks


def test_the_last_stage_returns_documents_with_their_tokens(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, None, "en", "a", 0), (7, "", None, None, 0)], docs.schema))
    out = corpus_pipeline.tokens(spark, docs, DATA)
    assert out.columns == [*docs.columns, "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, out.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks("byte_bpe_50k.tiktoken"), special_tokens={})
    for r in out.collect():
        assert r.token_ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids)
    plain = bpe_round_trip(docs)
    assert sorted(map(repr, out.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    assert corpus_pipeline.tokens(spark, docs.limit(0), DATA).count() == 0
