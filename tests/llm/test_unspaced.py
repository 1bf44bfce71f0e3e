"""Benchmark items in scripts without spaces, and items under five words."""

import random

import pytest

from tidemill.llm.decontamination import Items, leaks, without_leaks
from tidemill.llm.quality import keep_good
from tidemill.llm.shingle_sets import keep_one_of_similar
from tidemill.llm.word_hashes import plain

CHINESE = "数据去重是训练语料处理中最重要的步骤之一"
JAPANESE = "ベンチマークの問題文が学習データに含まれる"
THAI = "ภาษาไทยเขียนโดยไม่เว้นวรรคระหว่างคำ"


def found(items, *texts):
    return [[match[:2] for match in f] for f in Items(list(enumerate(items))).search(list(texts))]


@pytest.mark.parametrize("item", [CHINESE, JAPANESE, THAI])
def test_unspaced_items_are_found_whole_and_edited(item):
    middle = len(item) // 2
    texts = [f"前{item}后", f"one {item}, two", item[:middle] + "，" + item[middle:], item[:middle] + "犬" + item[middle + 1 :], item[:middle]]
    assert found([item], *texts) == [[(0, 0)], [(0, 0)], [(0, 0)], [(0, 1)], []]


def test_words_of_unspaced_scripts():
    assert plain("Ab。中文ｘ１（é）").decode().split() == ["ab", "中", "文", "x1", "é"]
    assert plain("naïve Straße Привет 한국어 단어").decode().split() == ["naïve", "straße", "Привет", "한국어", "단어"]


def test_short_items_must_stand_in_a_row(spark):
    items = ["Paris", "New York", "one two three", "a b c d", "Paris!", "北京", "", "!?"]
    texts = ["to paris", "parish", "new, york", "new big york", "one two", "three one two three", "a b c d e", "我在北京市", "北大京", "", None]
    hit = [[(0, 0), (4, 0)], [], [(1, 0)], [], [], [(2, 0)], [(3, 0)], [(5, 0)], [], [], []]
    assert found(items, *texts) == hit
    assert found(["three four"], "one two three", "four five") == [[], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([*enumerate(items), (9, None)], "item_id bigint, text string")
    rows = {(r.doc_id, r.item_id, r.edits, r.start_word, r.end_word) for r in leaks(docs, benchmark).collect()}
    assert rows == {(0, 0, 0, 1, 2), (0, 4, 0, 1, 2), (2, 1, 0, 0, 2), (5, 2, 0, 1, 4), (6, 3, 0, 0, 4), (7, 5, 0, 2, 4)}
    assert {r.doc_id for r in without_leaks(docs, benchmark).collect()} == {i for i, h in enumerate(hit) if not h}


def test_short_items_equal_a_plain_search():
    rng = random.Random(2)
    items = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    want = [{i for i, item in enumerate(items) if f" {item} " in f" {t} "} for t in texts]
    assert [{m[0] for m in f} for f in found(items, *texts)] == want


def test_the_pipeline_keeps_unspaced_texts_and_finds_their_near_copies(spark):
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x4E00, 0x5200)]
    base = "".join(rng.choice(letters) for _ in range(400))
    near, other = base[:200] + "一二三" + base[203:], "".join(rng.choice(letters) for _ in range(400))
    rows = [(1, base, "h"), (2, near, "h"), (3, other, "h"), (4, "太短", "h"), (5, "重复" * 100, "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    good = keep_good(docs)
    assert {r.doc_id for r in good.collect()} == {1, 2, 3}
    assert {r.doc_id for r in keep_one_of_similar(good).collect()} == {1, 3}
