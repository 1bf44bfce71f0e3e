"""Languages of texts by the probability of their words, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language gives each piece a
probability; the probability of a word is the sum over all ways to write it as pieces, which
the forward algorithm adds up from left to right. Probabilities are learned from labelled
documents by expectation-maximisation: expected uses of each piece over all segmentations.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import kept, map_rows

VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents of a language that a model is fitted on; those with the lowest hash.
FIT_DOCS = 300
ROUNDS = 2
SMOOTHING = 0.05
#: Expected probability of one character; keeps sums over a word near 1, so that they neither vanish nor overflow.
_SCALE = 24.0
#: Words longer than this are summed one by one and scaled at each step.
_LONG = 48
MEMO_WORDS = 300_000
_START = "▁"  # begins a word, as in the vocabulary
_letters = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if there is no letter."""
    found = _letters((text or "").lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


class Pieces:
    """The pieces of the vocabulary, numbered from 2; 0 is no piece, 1 any other character."""

    def __init__(self, pieces: list[str]):
        self.number = {piece: i + 2 for i, piece in enumerate(pieces)}
        self.starts = {piece[:n] for piece in pieces for n in range(1, len(piece) + 1)}
        self.longest = max(map(len, pieces), default=1)

    def __len__(self):
        return len(self.number) + 2

    def within(self, word: str) -> list[tuple[int, int, int]]:
        """``(start, length, number)`` of all pieces in a word; each character has one at least."""
        number, starts, found = self.number.get, self.starts, []
        for i in range(len(word)):
            if word[i] not in self.number:
                found.append((i, 1, 1))
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                part = word[i:j]
                if part not in starts:
                    break
                n = number(part)
                if n:
                    found.append((i, j - i, n))
        return found


@functools.cache
def public_pieces(vocabulary: str = VOCABULARY) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    ids = range(model.get_piece_size())
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return Pieces([model.id_to_piece(i) for i in ids if not special(i)])


class Forward:
    """Sums over segmentations, for all languages at once: ``table[piece, language]``."""

    def __init__(self, pieces: Pieces, table: np.ndarray):
        self.pieces, self.table = pieces, table
        lengths = np.ones(len(pieces))
        for piece, number in pieces.number.items():
            lengths[number] = len(piece)
        self.scaled = table * (_SCALE ** np.minimum(lengths, 64))[:, None]
        self.scaled[0] = 0

    def logs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(words), self.table.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for n, members in by_length.items():
            if n >= _LONG:
                for i in members:
                    out[i] = self._long(_START + words[i])
            else:
                out[members] = self._equal([_START + words[i] for i in members], n + 1)
        return out

    def _equal(self, words, n):
        longest = min(n, self.pieces.longest)
        ids = np.zeros((n, longest + 1, len(words)), np.int32)
        for w, word in enumerate(words):
            for start, length, number in self.pieces.within(word):
                ids[start + length - 1, length, w] = number
        sums = [np.ones((len(words), self.table.shape[1]))]
        for end in range(1, n + 1):
            total = 0.0
            for length in range(1, min(end, longest) + 1):
                at = ids[end - 1, length]
                if at.any():
                    total = total + sums[end - length] * self.scaled[at]
            sums.append(total)
        return np.log(sums[n]) - n * np.log(_SCALE)

    def _long(self, word):
        ending: list[list[tuple[int, int]]] = [[] for _ in word]
        for start, length, number in self.pieces.within(word):
            ending[start + length - 1].append((start, number))
        kept, logs = {0: np.ones(self.table.shape[1])}, 0.0
        for end, pieces in enumerate(ending, 1):
            total = sum(kept[start] * self.scaled[number] for start, number in pieces)
            top = total.max()
            logs += np.log(top)
            kept[end] = total
            kept = {at: value / top for at, value in kept.items() if at > end - self.pieces.longest}
        return np.log(kept[len(word)]) + logs - len(word) * np.log(_SCALE)


def expected_uses(pieces: Pieces, probabilities: np.ndarray, word: str) -> dict[int, float]:
    """How often each piece is used in a word, averaged over its segmentations."""
    if len(word) >= _LONG:
        return _expected_in_long(pieces, probabilities, _START + word)
    word = _START + word
    found = [(start, start + length, number, probabilities[number] * _SCALE**length) for start, length, number in pieces.within(word)]
    n = len(word)
    forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for start, end, _, p in sorted(found, key=lambda x: x[1]):
        forward[end] += forward[start] * p
    for start, end, _, p in sorted(found, key=lambda x: -x[0]):
        backward[start] += p * backward[end]
    uses: dict[int, float] = {}
    for start, end, number, p in found:
        uses[number] = uses.get(number, 0.0) + forward[start] * p * backward[end] / forward[n]
    return uses


def _expected_in_long(pieces, probabilities, word):
    """The same with sums kept as logs, which neither vanish nor overflow in a word of any length."""
    starting: list[list[tuple[int, int, float]]] = [[] for _ in word]
    ending: list[list[tuple[int, float]]] = [[] for _ in word]
    for start, length, number in pieces.within(word):
        p = float(probabilities[number])
        starting[start].append((start + length, number, p))
        ending[start + length - 1].append((start, p))
    n, exp, log = len(word), math.exp, math.log
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for end in range(1, n + 1):
        near = forward[end - 1]
        forward[end] = near + log(sum(p * exp(forward[start] - near) for start, p in ending[end - 1]))
    for start in range(n - 1, -1, -1):
        near = backward[start + 1]
        backward[start] = near + log(sum(p * exp(backward[end] - near) for end, _, p in starting[start]))
    uses: dict[int, float] = {}
    for start, found in enumerate(starting):
        for end, number, p in found:
            uses[number] = uses.get(number, 0.0) + p * exp(forward[start] + backward[end] - forward[n])
    return uses


def fit(labelled: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, smoothing: float = SMOOTHING):
    """Languages and the probability of each piece in each, from ``labelled(lang, text)``.

    Word counts and expected uses are summed on the cluster. What reaches the driver is one
    number for each piece and language, which the vocabulary and the set of labels bound.
    """
    tally, drop = kept(_tally(labelled), "tally")
    langs = sorted(r.lang for r in tally.select("lang").distinct().collect())
    size = len(public_pieces(vocabulary))
    table = np.full((size, len(langs)), 1.0 / size)
    column = {lang: k for k, lang in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        counts = np.full(table.shape, smoothing)
        counts[0] = 0
        for r in _uses(tally, vocabulary, table, column).collect():
            counts[r.piece, column[r.lang]] += r.uses
        table = counts / counts.sum(axis=0)
    drop()
    return langs, table


def _tally(labelled):
    def make():
        def run(langs, texts):
            tallies: dict[tuple[str, str], int] = {}
            for lang, text in zip(langs, texts):
                for word in words_of(text):
                    tallies[lang, word] = tallies.get((lang, word), 0) + 1
            return [k[0] for k in tallies], [k[1] for k in tallies], list(tallies.values())

        return run

    found = map_rows(labelled, ["lang", "text"], "lang string, word string, n bigint", make)
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _uses(tally, vocabulary, table, column):
    shared = tally.sparkSession.sparkContext.broadcast(table)

    def make():
        pieces, own = public_pieces(vocabulary), {lang: shared.value[:, k].copy() for lang, k in column.items()}

        def run(langs, words, numbers):
            total: dict[tuple[str, int], float] = {}
            for lang, word, n in zip(langs, words, numbers):
                for piece, uses in expected_uses(pieces, own[lang], word).items():
                    total[lang, piece] = total.get((lang, piece), 0.0) + n * uses
            return [k[0] for k in total], [k[1] for k in total], list(total.values())

        return run

    found = map_rows(tally, ["lang", "word", "n"], "lang string, piece int, uses double", make)
    return found.groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))


class Scorer:
    """Scores texts; words of usual length and their logs are remembered, up to a number of words."""

    def __init__(self, langs, table, vocabulary):
        self.langs, self.forward = langs, Forward(public_pieces(vocabulary), table)
        self.places: dict[str, int] = {}
        self.logs = np.empty((0, len(langs)))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [words_of(t) for t in texts]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        self._learn({w for words in found for w in words if len(w) < _LONG})
        preds, scores = [], []
        for words in found:
            if not words:
                preds.append("und")
                scores.append(0.0)
                continue
            total = self.logs[[self.places[w] for w in words if len(w) < _LONG]].sum(axis=0)
            long = [w for w in words if len(w) >= _LONG]
            if long:
                total = total + self.forward.logs(long).sum(axis=0)
            best = int(total.argmax())
            preds.append(self.langs[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return preds, scores

    def _learn(self, words):
        if len(self.places) > MEMO_WORDS:
            self.places, self.logs = {}, self.logs[:0]
        new = [w for w in words if w not in self.places]
        if new:
            for i, word in enumerate(new, len(self.places)):
                self.places[word] = i
            if len(self.places) > len(self.logs):
                room = np.empty((len(self.places) + MEMO_WORDS // 8, len(self.langs)))
                room[: len(self.logs)] = self.logs
                self.logs = room
            self.logs[len(self.places) - len(new) : len(self.places)] = self.forward.logs(new)


_scorers: dict[int, Scorer] = {}


def predict(docs: DataFrame, langs, table, carry: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``carry``, ``lang_pred`` and ``score``; a map. The model is broadcast: its size is fixed by
    the vocabulary and the set of labels."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    key = shared._jbroadcast.id()

    def make():
        if key not in _scorers:  # one for a worker process, of the latest model
            _scorers.clear()
            _scorers[key] = Scorer(*shared.value, vocabulary)
        scorer = _scorers[key]
        return lambda *columns: [*columns[:-1], *scorer.score(columns[-1])]

    return map_rows(docs, [*carry, text_col], f"{kinds}, lang_pred string, score double", make)


def identify_languages(
    docs: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``.

    Learns from at most ``fit_docs`` documents of each language among those whose label is not
    null and whose crc32 of the id, modulo 5, is not 0; predicts all from their text alone.
    ``score`` is the probability of the language given the text when all are equally likely
    before. Null texts and texts without a letter are ``und`` with score 0, as is everything if
    no label can be learned from. A null id is neither held out nor learned from. Ties go to
    the language that sorts first. Repeated rows stay; other columns are not read.
    """
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    labelled = docs.where((remainder != 0) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("hash")
    )
    # Only rows with low hashes are ranked, several times as many as needed, whatever the input's size.
    share = F.least(F.lit(1.0), F.lit(10.0 * fit_docs) / F.count(F.lit(1)))
    shares, drop = kept(labelled.groupBy("lang").agg(share.alias("share")), "shares")
    low = labelled.join(F.broadcast(shares), "lang").where(F.pmod("hash", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    by_hash = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 20)), "hash", "id")
    ranked = low.withColumn("rank", F.row_number().over(by_hash))
    langs, table = fit(ranked.where(F.col("rank") <= fit_docs).select("lang", "text"), vocabulary)
    drop()
    rows = docs.select(F.col(id_col), F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    return predict(rows, langs, table, [id_col, "held_out"], "_text", vocabulary)
