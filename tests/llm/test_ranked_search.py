"""Ranked search against scores of all documents, with ties, odd rows and segments of few documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import ranked_search as R

TERM = re.compile(R._TERM)


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked_plainly(docs, items, k=10):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n, total = sum(map(bool, lengths)), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, found in wanted.items():
        scores = []
        for (doc, c), length in zip(counts, lengths):
            score = 0
            for t in found & set(c):
                weight, m = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))), 10 + 90 * length * n // total
                score += weight * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc))
        scores = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(scores, 1)]
    return sorted(out, key=repr)


def made_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "日本", "X9", "the", "THE", "a_b"]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(5, 66)]) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    docs += [(1000 + i, "copied text w1 w2 w3") for i in range(200)] + [(None, "w1 w2"), (None, None), (5, "w1 w2"), (6, "")]
    docs.append((7, "long " * 400_000 + "w1"))
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(20)]
    return docs, items + [(None, "copied"), (30, "copied W1"), (30, "w3"), (31, None), (32, "nowhere"), (33, "..."), (34, "the The w1 w1")]


@pytest.mark.parametrize("docs_a_segment, block", [(R.SEGMENT_DOCS, R.BLOCK_BYTES), (50, R.BLOCK_BYTES), (R.SEGMENT_DOCS, 300)])
def test_ranking_equals_all_scores(spark, monkeypatch, docs_a_segment, block):
    monkeypatch.setattr(R, "SEGMENT_DOCS", docs_a_segment)
    docs, items = made_rows()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"ids": R.F.lit(1), "term": R.F.lit("x")}).repartition(3)
    found = R.ranked_search(table, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block).collect()
    assert sorted(map(tuple, found), key=repr) == ranked_plainly(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert R.ranked_search(docs.limit(0), items).count() == R.ranked_search(docs, items.limit(0)).count() == 0


def test_few_documents_are_scored_where_impacts_differ():
    rng = np.random.default_rng(2)
    n, terms_n = 4000, 20
    doc = np.concatenate([np.sort(rng.choice(n, 1000, replace=False)) for _ in range(terms_n)])
    term, impact = np.repeat(np.arange(terms_n), 1000), (1e6 * rng.pareto(1.5, terms_n * 1000)).astype(np.int64) + 1
    segment, asked = R.Segment(n, doc, term, impact, terms_n), 0
    whole = np.bincount(doc, impact, n).astype(np.int64)
    of = segment._intervals

    def counted(owner, start, end):
        nonlocal asked
        asked += len(np.unique(owner))
        return of(owner, start, end)

    segment._intervals = counted
    item, found, score = segment.search([np.arange(terms_n)], np.zeros(1, np.int64), 10)
    best = np.lexsort((np.arange(n), -whole))[:10]
    assert found.tolist() == best.tolist() and score.tolist() == whole[best].tolist() and asked < n / 4
