"""Decontamination, languages, quality, secrets and page text against plain versions or planted cases."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from compare import connect, differences
from conftest import DATA
from pyspark.sql import functions as F

from tidemill.llm import decontamination
from tidemill.llm.decontamination import Items, best_match, leaks, without_leaks
from tidemill.llm.html_text import content_lines, extract_text, main_text
from tidemill.llm.language_id import Forward, Pieces, expected_uses, identify_languages, words_of
from tidemill.llm.quality import host_verdicts, keep_good, measure, quality_rules, with_measures
from tidemill.llm.queries import ORACLES, QUERIES
from tidemill.llm.secret_scan import find, findings, redact_secrets, secret_scan
from tidemill.llm.word_hashes import plain, word_hashes
from tidemill.session import scratch_path


@pytest.mark.parametrize("name", ORACLES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), connect(DATA), ORACLES[name]) is None


# Decontamination


def edits_plainly(item, words):
    """Least word edits between the item and any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def planted(rng, share):
    vocabulary = [f"{a}{b}" for a in "kltmnprs" for b in "aeiou"] + ["the", "of", "and"] * 4
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(12, 50)))) for i in range(25)]
    docs = []
    for i in range(120):
        text = words(rng.randint(0, 80))
        if i % 2:
            inner = rng.choice(items)[1].split()
            for _ in range(int(share * len(inner))):
                at = rng.randrange(len(inner))
                inner[at : at + rng.randint(0, 1)] = rng.choice([[], words(1)])
                inner = inner or ["x"]
            text = text + inner + words(rng.randint(0, 40))
        docs.append((i, ", ".join(text) if i % 3 else " ".join(text).title()))
    return items, docs


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_leaks_equal_edit_distance_to_all_stretches(spark, share):
    items, docs = planted(random.Random(4), share)
    split = lambda t: re.findall(r"[a-z]+", t.lower())
    want = {}
    for (i, text), (k, item) in itertools.product(docs, items):
        own = split(item)
        if (cost := edits_plainly(own, split(text))) <= int(0.2 * len(own)):
            want[i, k] = cost
    got = {(r.doc_id, r.item_id): r.edits for r in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 0
    assert all(got[pair] == want[pair] for pair in got)


def test_leaks_in_blocks_of_items_and_in_junk(spark):
    items, docs = planted(random.Random(8), 0)
    docs += [(900, "the of " * 4000), (901, None), (None, ""), (902, items[3][1]), (902, items[3][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, edits int")
    benchmark = spark.createDataFrame([*items, (99, None), (98, "too short")], "item_id bigint, text string")
    whole = sorted(map(tuple, leaks(docs, benchmark).collect()))
    assert sorted(map(tuple, leaks(docs, benchmark, block_bytes=700).collect())) == whole
    assert [r[0] for r in whole].count(902) == 2 and not {900, 901} & {r[0] for r in whole}
    clean = without_leaks(docs, benchmark, block_bytes=700)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {r[0] for r in whole}
    assert leaks(docs.limit(0), benchmark).count() == leaks(docs, benchmark.limit(0)).count() == 0


def test_best_match_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        item, words = ([rng.randrange(4) for _ in range(rng.randint(1, n))] for n in (8, 20))
        cost, start, end = best_match(np.array(item), np.array(words))
        assert cost == edits_plainly(item, words) and 0 <= start <= end <= len(words)
        assert edits_plainly(item, words[start:end]) == cost


def test_hashes_of_words_do_not_depend_on_place_or_chunks(monkeypatch):
    texts = [plain(t) for t in ("One two, TWO.", "", "two " * 50 + "x" * 300, "one")]
    words, bounds = word_hashes(texts)
    assert np.diff(bounds).tolist() == [3, 0, 51, 1] and words[0] == words[-1] and words[1] == words[2] == words[3]
    monkeypatch.setattr("tidemill.llm.word_hashes.CHUNK", 64)
    assert (word_hashes(texts)[0] == words).all()


def test_every_item_is_found_whole():
    items, _ = planted(random.Random(2), 0)
    found = Items(items).search([f"a b c {text} d e" for _, text in items])
    assert all(any(m[0] == name and m[1] == 0 for m in f) for (name, _), f in zip(items, found))
    assert decontamination.repetitions(0.9) < decontamination.repetitions(0.99)


# Languages


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces.number:
            for rest in segmentations(word[n:], pieces):
                yield [pieces.number[word[:n]], *rest]


def test_forward_sums_over_all_segmentations():
    pieces = Pieces(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"])
    table = np.random.default_rng(3).random((len(pieces), 2))
    forward = Forward(pieces, table)
    words = ["a", "b", "ab", "abab", "babaab", "abababab"]
    for word, logs in zip(words, forward.logs(words)):
        ways = list(segmentations("▁" + word, pieces))
        for k in range(2):
            assert logs[k] == pytest.approx(math.log(sum(math.prod(table[p, k] for p in way) for way in ways)))
        weights = [math.prod(table[p, 0] for p in way) for way in ways]
        uses = {p: sum(w * way.count(p) for w, way in zip(weights, ways)) / sum(weights) for way in ways for p in way}
        assert expected_uses(pieces, table[:, 0], word) == pytest.approx(uses)
    assert forward.logs(["ab" * 400])[0] == pytest.approx(forward._long("▁" + "ab" * 400))
    assert forward.logs(["aé"])[0][0] == pytest.approx(np.log(forward.table[1, 0] * (table[pieces.number["▁a"], 0] + table[pieces.number["▁"], 0] * table[pieces.number["a"], 0])))


def test_held_out_documents_get_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.lang for r in docs.collect()}
    rows = identify_languages(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 100 < len(held) < 300 and all(0 <= r.score <= 1 for r in rows)
    assert sum(labels[r.doc_id] == r.lang_pred for r in held) > 0.97 * len(held)


def test_texts_without_letters_labels_or_rows(spark):
    assert words_of("12 ½ ²") == [] and words_of("A1é") == ["a", "é"]
    rows = [(1, "Guten Tag und", "de"), (2, None, "de"), (3, "1 2 ½ 🎉", "de"), (None, "und", "de"), (None, "und", "de"), (4, "x" * 200_000, None)]
    docs = spark.createDataFrame([(i, t, lang, 1.0) for i, t, lang in rows], "doc_id bigint, text string, lang string, score double")
    got = identify_languages(docs).collect()
    assert sorted((repr(r.doc_id), r.lang_pred) for r in got)[:3] == [("1", "de"), ("2", "und"), ("3", "und")]
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    none = identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in identify_languages(docs.where("doc_id is null")).collect()} == {"und"}
    assert len(none) == 6 and identify_languages(docs.limit(0)).count() == 0


# Quality


def test_measures():
    assert measure(None) == measure("") == measure(" \n\t ") == (0, 0, 0, 0, 0)
    assert measure("a b c a b c") == (6, 6, 0, 0, 6)
    assert measure("a a a a") == (4, 4, 0, 0, 4)
    assert measure("x#\ny\nx#\n\n \nx#")[2:4] == (3, 2)
    assert measure("é é z")[:2] == (2, 4)


def test_hosts_with_few_documents_are_drawn_to_the_common_rate(spark):
    good = "word%d " * 60 % tuple(range(60))
    rows = [(i, "# " * 200 if i % 10 < 2 else good, f"h{i // 10}") for i in range(200)] + [(300 + i, "# " * 200, "bad") for i in range(100)]
    rows += [(500, "# " * 60, "one"), (501, good, None), (502, good, "bad"), (503, good + "# " * 30, "one more")]
    docs = spark.createDataFrame([(i, t, s, True) for i, t, s in rows], "doc_id bigint, text string, source string, kept boolean")
    rates = {r.host: r for r in host_verdicts(with_measures(docs, ["source"])).collect()}
    assert len(rates) == 23 and 0.2 < rates["h3"].rate < rates["one"].rate < 0.5 < rates["bad"].rate
    assert [h for h, r in rates.items() if r.rejected] == ["bad"]
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert kept[2] and kept[501] and kept[503] and not kept[502] and not kept[0] and not kept[300] and not kept[500]
    good_ids = {r.doc_id for r in keep_good(docs).collect()}
    assert good_ids == {i for i, k in kept.items() if k}
    assert quality_rules(docs.limit(0)).count() == keep_good(docs.limit(0)).count() == 0


# Secrets


def test_spans():
    text = 'Password = "abcdefgh1" AKIAABCDEFGHIJKL token:short7 ' + "0" * 32
    kinds = [(k, text[s:e]) for k, s, e in find(text)]
    assert kinds == [("assign", 'Password = "abcdefgh1'), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0" * 32)]
    assert find("PAſſWORD=abcdefghi") == [] and find("AKIA" + "B" * 11) == [] and find("f" * 31) == []
    assert find("api_key: xx api-key=12345678 APIKEY='12345678'") == [("assign", 29, 45)]
    assert [k for k, _, _ in find("token=" + "a" * 40)] == ["assign", "hex"]


def test_the_ledger_scans_each_blob_once_for_each_version_of_the_rules(spark):
    ledger = scratch_path(spark, "ledger")
    docs = spark.createDataFrame([(1, "secret=abcdefgh"), (2, "secret=abcdefgh"), (3, None), (None, "no")], "doc_id bigint, text string")
    scanned = lambda: spark.read.parquet(f"{ledger}/scanned").count()
    first = sorted((repr(r.doc_id), r.n_assign, r.spans) for r in secret_scan(docs, ledger=ledger).collect())
    assert first == [("1", 1, "assign:0:15"), ("2", 1, "assign:0:15"), ("3", 0, ""), ("None", 0, "")] and scanned() == 3
    more = docs.union(spark.createDataFrame([(4, "new token = abcdefgh")], docs.schema))
    assert secret_scan(more, ledger=ledger).where("n_assign = 1").count() == 3 and scanned() == 4
    rules = (("digits", r"\d+", 0, 3),)
    secret_scan(more, ledger=ledger, rules=(*rules, ("assign", "a^", 0, 1), ("access", "a^", 0, 1), ("hex", "a^", 0, 1))).collect()
    assert scanned() == 8 and findings(spark, ledger).count() == 2
    assert secret_scan(docs.limit(0)).count() == 0


def test_redaction(spark):
    text = 'é token = "' + "a" * 40 + '" and AKIAABCDEFGHIJKL.'
    docs = spark.createDataFrame([(1, text, 70, "x"), (1, None, 0, "y"), (2, "plain", 5, None)], "doc_id bigint, text string, n_chars bigint, blob string")
    got = {(r.text, r.n_chars, r.blob) for r in redact_secrets(docs).collect()}
    assert got == {('é [assign]" and [access].', 25, "x"), (None, 0, "y"), ("plain", 5, None)}


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h2>Title &amp; more</h2></header><p>First   <b>bold</b>&nbsp;text<br>next line.<p>Second, with enough words to be content.
<button>Share</button><form><p>Name <input></form><p>Short.</p><div id="comments"><p>Reader says something long enough to count as text</div></article>
<aside>Aside</aside><footer>&copy; us"""


def test_pages():
    assert main_text(PAGE) == "Title & more\nFirst bold text next line.\nSecond, with enough words to be content.\nShort."
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<script>1") == ""
    loose = "<body><div class=menu>a b</div>" + "<div><a>x</a><a>y</a></div>" * 6 + "<div>" + "A long sentence of content. " * 9 + "</div><div>Tail words here.</div><div>" + "More of the long content. " * 9 + "</div><footer>f</footer>"
    assert main_text(loose).count("\n") == 2 and "x" not in main_text(loose).split("\n")[0]
    assert main_text("<p>only &lt;text&gt;</p>") == "only <text>" and main_text("a</p></div>b") == "a\nb"
    assert content_lines([]) == content_lines([0.0, 0.0]) == [] and content_lines([1.0]) == [0]


def test_labels_of_layouts_and_article_heads():
    page = """<div class="page has-sidebar"><article class="post comments-open"><div class="post-header">Head</div>
    <p>A text of some length stands here.</p><div class="post_ad-box">Buy</div><div class="share-bar">Share</div></article>
    <div id="main-sidebar">Side</div><article class="comment"><p>Reader text that is rather long as well.</p></article></div>"""
    assert main_text(page) == "Head\nA text of some length stands here."


def test_page_rows(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2), (2, "v", "<p>" + "word " * 100_000, 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = extract_text(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, *[len(main_text(PAGE))] * 2, 499_999]
    assert extract_text(pages.limit(0)).count() == 0
