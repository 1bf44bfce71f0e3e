"""Languages of texts whose words are long runs of letters, as in scripts without spaces."""

import random

import numpy as np
import pytest

from tidemill.llm import language_id
from tidemill.llm.language_id import Pieces, expected_uses, identify_languages

ALPHABETS = {"zz": "abcdefgh的一是在不了有和人这", "yy": "hgfedcbaのにはをたがでてとし"}


@pytest.mark.parametrize("length", [60, 10_000])
def test_long_runs_are_learned_from_and_told_apart(spark, length):
    rng = random.Random(length)
    runs = lambda lang: "".join(rng.choice(ALPHABETS[lang]) for _ in range(length))
    rows = [(i, runs(lang), lang) for i, lang in enumerate(["yy", "zz"] * (60 if length < 1000 else 8))]
    got = identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in rows}
    assert any(r.held_out for r in got)


def test_long_and_short_words_agree(monkeypatch):
    pieces = Pieces(["▁", "a", "b", "ab", "ba", "aba", "▁a"])
    p = np.random.default_rng(5).random(len(pieces))
    word = "abaabbaxab"
    plain = expected_uses(pieces, p, word)
    monkeypatch.setattr(language_id, "_LONG", 3)
    scaled = expected_uses(pieces, p, word)
    assert scaled.keys() == plain.keys() and all(abs(scaled[k] - plain[k]) < 1e-12 for k in plain)
    whole = expected_uses(pieces, p, "ab" * 50_000)
    length = {number: len(piece) for piece, number in pieces.number.items()}
    assert abs(sum(n * length[k] for k, n in whole.items()) - 100_001) < 1e-3
