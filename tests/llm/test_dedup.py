"""Repeated strings, near duplicates and shards against plain versions of themselves."""

import collections
import hashlib
import random

import pytest
import xxhash
from conftest import DATA

from tidemill.llm import suffix_dedup
from tidemill.llm.components import components
from tidemill.llm.sharding import minimax_shards
from tidemill.llm.simhash import BkTree, fingerprint, keep_one_of_each, near_links, simhash_components
from tidemill.llm.suffix_dedup import COVER, MODULUS, repeated_strings

SCHEMA = "doc_id bigint, text string, size bigint, block string"
AWKWARD = [(1, None), (None, ""), (None, None), (2, "a" * 30_000), (3, "ab" * 500), (3, "ab" * 500), (4, "x y z"), (5, "é" * 700)]


def awkward(spark):
    return spark.createDataFrame([(i, t, 1, "b") for i, t in AWKWARD], SCHEMA)


def removed_plainly(texts, length=400):
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


def compare_removed(spark, docs, **options):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((repr(r.doc_id), *w) for r, w in zip(rows, removed_plainly([r.text for r in rows])))
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_strings(docs, **options).collect())
    assert got == want


def test_the_cover_is_a_difference_cover():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


def test_repeated_strings_of_awkward_rows(spark):
    compare_removed(spark, awkward(spark).where("length(text) < 2000 or text is null"))
    assert {r.n_removed for r in repeated_strings(awkward(spark)).where("doc_id = 2").collect()} == {30_000}
    assert repeated_strings(awkward(spark).limit(0)).count() == 0
    kept = [r for r in repeated_strings(awkward(spark)).collect() if "\ufffd" not in r.kept_text]
    assert kept and all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in kept)


def test_repeated_strings_at_every_offset_and_border(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows, i = [], 0
    for size in (399, 400, 401, 431, 472, 473, 900, 2000):
        for _ in range(8):
            shared = word(size)
            for _ in range(2):
                rows.append((i := i + 1, word(rng.choice([0, 1, 71, 300])) + shared + word(rng.choice([0, 1, 399]))))
    edited = word(3000)
    for _ in range(12):
        at = rng.randrange(3000)
        rows.append((i := i + 1, edited[:at] + "#" + edited[at + 1 :]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    compare_removed(spark, docs)
    compare_removed(spark, docs, block_bytes=1500)


def test_blocks_may_hold_a_third_of_all_rows_as_one_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TEXT_BUCKET_BYTES", 4000)
    docs = spark.createDataFrame([(i, "same words again " * 30 if i % 3 else f"{i} " * 200) for i in range(60)], "doc_id bigint, text string")
    compare_removed(spark, docs.repartition(3), block_bytes=3000)


def fingerprint_plainly(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_plainly(prints, radius=3):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(parent)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in order}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d E F É ß", "the the the the the", "x\ty\nz w"])
def test_fingerprints(text, spark):
    assert fingerprint(text) == fingerprint_plainly(text)


def test_components_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    prints = {r.doc_id: fingerprint_plainly(r.text) for r in rows}
    top = roots_plainly(set(prints.values()))
    smallest = {}
    for doc, p in prints.items():
        smallest[top[p]] = min(doc, smallest.get(top[p], doc))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash_components(docs).collect()}
    assert got == {doc: (p, smallest[top[p]]) for doc, p in prints.items()}


def clouds(n=40, seed=1):
    rng, out = random.Random(seed), {0, (1 << 64) - 1, 1 << 63}
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(12):
            centre ^= 1 << rng.randrange(64)
            out.add(centre)
    return out


@pytest.mark.parametrize("max_tree", [2, 512])
def test_links_connect_what_all_pairs_connect(spark, max_tree):
    values = clouds()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = spark.createDataFrame([(signed(v),) for v in values], "print bigint")
    links = near_links(prints, 3, max_tree).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3 for r in links)
    want = collections.defaultdict(set)
    for value, root in roots_plainly(values).items():
        want[root].add(signed(value))
    got = collections.defaultdict(set)
    for r in components(near_links(prints, 3, max_tree)).collect():
        got[r.root].add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_a_dense_group_gives_a_forest_not_all_pairs():
    tree, values = BkTree(3), [0, *(1 << b for b in range(64))]
    assert sum(len(tree.add(v)) for v in values) == len(values) - 1


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}


def test_near_duplicates_of_awkward_rows(spark):
    docs = awkward(spark)
    assert simhash_components(docs).count() == len(AWKWARD)
    empty = {r.component_id for r in simhash_components(docs).where("fingerprint = '0000000000000000'").collect()}
    assert empty == {1}
    stay = keep_one_of_each(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == [1, 2, 3, 4, 5]
    assert keep_one_of_each(docs.limit(0)).count() == simhash_components(docs.limit(0)).count() == 0


def shards_plainly(sizes, shards):
    """Least capacity of a contiguous partition, by trying all that matter."""

    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("rows", ["mixed", "hot"])
def test_shards_are_as_small_as_can_be(spark, rows):
    rng = random.Random(9)
    texts = [f"{i} " * rng.randint(1, 40) for i in range(150)]
    texts += ["hot text " * 20] * 90 if rows == "hot" else texts[:20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(6)
    got = minimax_shards(docs, 8).collect()
    shard_of = {}
    for r in got:
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
        assert r.size == len(texts[r.doc_id]) + 1 and r.law == "bytes" and r.grown_shard is None
    order = docs.selectExpr("xxhash64(text) h", "length(text) + 1 n").groupBy("h").sum("n").orderBy("h").collect()
    loads = collections.Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) == shards_plainly([r[1] for r in order], 8)
    for shard in loads:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shards_of_awkward_rows(spark):
    got = minimax_shards(awkward(spark), 3).collect()
    assert len(got) == len(AWKWARD) and len({r.shard for r in got if r.size == 1}) == 1
    assert minimax_shards(awkward(spark).limit(0)).count() == 0
