"""Near duplicates by Jaccard similarity against all pairs."""

import itertools
import random

from conftest import DATA
from test_dedup import SCHEMA, awkward

import corpus_pipeline
from tidemill.llm import shingle_sets
from tidemill.llm.shingle_sets import bands, dealt, keep_one_of_similar, shingle_set, similar_links


def shingles_plainly(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def kept_plainly(texts):
    """Smallest ids of the components of all pairs of Jaccard similarity 0.8 or more."""
    sets, parent = {i: shingles_plainly(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if alike(sets[a], sets[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i for i in texts if top(i) == i}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(0, len(words), 5), n):
        words[at] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_the_stage_equals_all_pairs_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = kept_plainly({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()} == want


def test_the_stage_finds_edited_copies_and_checks_links(spark):
    rng, texts = random.Random(3), {}
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for n in (0, 2, 4, 6, 12, 30):  # Jaccard to the first about 0.97, 0.93, 0.9, 0.82, 0.5
            texts[len(texts)] = edited(rng, base, n)
    hot = [f"h{i}" for i in range(300)]
    for _ in range(120):
        texts[len(texts)] = edited(rng, hot, 3)
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in texts.items()], SCHEMA).repartition(4)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()}
    assert got == kept_plainly(texts)


def test_a_bucket_of_several_components_is_compared_to_the_end(spark):
    rng, texts = random.Random(6), {}
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for n in (0, 3, 3):
            texts[len(texts)] = edited(rng, base, n)
    sets = spark.createDataFrame([(i, bytearray(shingle_set(t).tobytes())) for i, t in texts.items()], "node bigint, hashes binary")
    members = spark.createDataFrame([(7, i) for i in texts], "bucket bigint, node bigint")
    dropped = {r.node for r in similar_links(members, sets).collect() if r.node != r.root}
    assert set(texts) - dropped == kept_plainly(texts) and len(dropped) == 12


def test_recall_of_the_bands_at_the_least_similarity():
    rng, found, pairs = random.Random(7), 0, 0
    while pairs < 1000:
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = edited(rng, base, 4)
        a, b = shingles_plainly(" ".join(base)), shingles_plainly(other)
        if alike(a, b) and 10 * len(a & b) < 8.3 * len(a | b):
            pairs += 1
            found += bool(set(bands(shingle_set(" ".join(base))).tolist()) & set(bands(shingle_set(other)).tolist()))
    assert found >= 995


def test_awkward_rows(spark):
    stay = keep_one_of_similar(awkward(spark))
    assert stay.columns == awkward(spark).columns and sorted(r.doc_id for r in stay.collect()) == [1, 2, 3, 4, 5]
    assert keep_one_of_similar(awkward(spark).limit(0)).count() == 0


def test_fingerprints_in_trees_give_candidates_of_their_own(spark, monkeypatch):
    rng, texts = random.Random(8), {}
    for _ in range(5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        for n in (0, 1, 1):
            texts[len(texts)] = edited(rng, base, n)
    monkeypatch.setattr(shingle_sets, "bands", lambda hashes: hashes[:1].view("int64") * 0 + len(texts) + int(hashes.sum() >> 1))
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in texts.items()], SCHEMA)
    got = {r.doc_id for r in keep_one_of_similar(docs).collect()}
    assert got >= kept_plainly(texts) == {0, 3, 6, 9, 12} and len(got) < 8  # 15 without the trees


def crowd(spark):
    """One bucket of texts that share three quarters, few of them alike."""
    rng, texts = random.Random(9), {}
    base = [f"w{i}" for i in range(200)]
    for _ in range(60):
        texts[len(texts)] = edited(rng, base, rng.choice((1, 2, 6, 9)))
    sets = spark.createDataFrame([(i, bytearray(shingle_set(t).tobytes())) for i, t in texts.items()], "node bigint, hashes binary")
    return texts, sets


def test_a_crowded_bucket_is_compared_by_blocks(spark):
    texts, sets = crowd(spark)
    members = spark.createDataFrame([(7, i) for i in texts], "bucket bigint, node bigint")
    dropped = {r.node for r in similar_links(members, sets, block_rows=4).collect() if r.node != r.root}
    assert set(texts) - dropped == kept_plainly(texts) and 1 < len(kept_plainly(texts)) < 60


def test_rows_of_a_crowded_bucket_do_not_grow_with_its_pairs(spark):
    texts, sets = crowd(spark)
    unlike = spark.createDataFrame([(7, i, i) for i in texts], "bucket bigint, node bigint, root bigint")
    assert dealt(unlike, sets, 512).count() == 60
    assert dealt(unlike, sets, 20).count() <= 60 * 4
    strays = spark.createDataFrame([(7, i, max(i, 57)) for i in texts], "bucket bigint, node bigint, root bigint")
    assert dealt(strays, sets, 10).count() <= 60 + 2 * 6
