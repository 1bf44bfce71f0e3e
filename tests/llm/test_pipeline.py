"""The whole pipeline against a plain version of each stage."""

import hashlib
from itertools import combinations

import tiktoken
from conftest import DATA
from public_tokenizers import PATTERN

import corpus_pipeline
from tidemill.llm.bpe import read_ranks
from tidemill.llm.secret_scan import find


def shingles_plainly(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def passes(text):
        words = text.split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        return len(words) >= 50 and 100 * len(marked) <= 50 * len(words)

    good = {r.doc_id: r.text for r in docs if passes(r.text)}
    sets = {doc: shingles_plainly(text) for doc, text in good.items()}
    alike = [(a, b) for a, b in combinations(sorted(good), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    best = {doc: doc for doc in sorted(good)}
    for _ in good:
        before = dict(best)
        for a, b in alike:
            best[a] = best[b] = min(best[a], best[b])
        if best == before:
            break
    clean = {doc: good[doc] for doc in set(best.values()) if not any(item in good[doc] for item in items)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks("byte_bpe_50k.tiktoken"), special_tokens={})
    want = {}
    for doc, text in clean.items():
        new, at = "", 0
        for kind, start, end in find(text):
            if start >= at:
                new += text[at:start] + f"[{kind}]"
            at = max(at, end)
        ids = library.encode_ordinary(new + text[at:])
        sha = lambda data: hashlib.sha256(data).hexdigest()
        want[doc] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((new + text[at:]).encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 0 < len(want) < len(docs)


def test_stages_keep_columns_and_take_awkward_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, shard int"
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None, None, None, None, None, 1), (None, long, "en", "a", 5, "h", 1), (None, long, "en", "a", 5, "h", 1), (3, "", None, "a", 0, None, 1)]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, DATA)
            assert out.columns == docs.columns
            out.collect()
    assert corpus_pipeline.quality(spark, docs, DATA).count() == 2
    assert corpus_pipeline.near_duplicates(spark, docs, DATA).count() == 2
    assert corpus_pipeline.tokens(spark, docs, DATA).count() == 4
