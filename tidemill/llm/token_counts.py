"""Token counts of a byte-level BPE without making the tokens."""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows
from tidemill.llm.pretokens import splitter

#: Words whose counts are remembered in a task; the memo is emptied when full.
MEMO_WORDS = 400_000
MEMO_CHARS = 64


class PairHeap:
    """Counts the symbols that remain of a word after all merges.

    The word is a linked list of symbols. A heap holds its adjacent pairs by rank and place;
    the lowest is popped and, if both symbols still stand there, merged, which makes up to two
    new pairs. A word of n bytes takes O(n log n) steps. The count is n minus the merges.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.numbers = {bytes([b]): b for b in range(256)}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            made = self.numbers.setdefault(left + right, len(self.numbers))
            self.pairs[self.numbers[left] << 32 | self.numbers[right]] = (rank, made)

    def count(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        find, symbols = self.pairs.get, list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (pair[0], i, symbols[i], symbols[i + 1], pair[1])
            for i in range(n - 1)
            if (pair := find(symbols[i] << 32 | symbols[i + 1]))
        ]
        heapify(heap)
        merged = 0
        while heap:
            _, i, left, right, made = heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            merged += 1
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if pair := find(made << 32 | symbols[k]):
                    heappush(heap, (pair[0], i, made, symbols[k], pair[1]))
            h = before[i]
            if h >= 0 and (pair := find(symbols[h] << 32 | made)):
                heappush(heap, (pair[0], h, symbols[h], made, pair[1]))
        return n - merged


class _Memo(dict):
    def __init__(self, count):
        self.count = count

    def __missing__(self, word):
        n = self.count(word.encode())
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


def read_vocabulary(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """The merges, as bytes, and the special strings of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    # Fixed rule of such files: printable bytes stand for themselves, the others in turn for U+0100 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
    plain = lambda symbol: bytes(byte_of[c] for c in symbol)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"])
    return [(plain(a), plain(b)) for a, b in pairs], [t["content"] for t in whole["added_tokens"]]


@functools.cache
def text_counter(vocabulary: str):
    """A function from a text to its number of tokens; special strings count as one token each.

    A worker process has one for all its tasks, which share the words it remembers.
    """
    merges, special = read_vocabulary(public_tokenizers.path(vocabulary))
    words, count = splitter(public_tokenizers.PATTERN), _Memo(PairHeap(merges).count).__getitem__

    def of(text: str) -> int:
        parts, extra = [text], 0
        for s in sorted(special, key=len, reverse=True):
            if s in text:
                extra += sum(p.count(s) for p in parts)
                parts = [x for p in parts for x in p.split(s)]
        return extra + sum(sum(map(count, words(p))) for p in parts)

    return of


def token_counts(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    A map over the documents without shuffle. Null text is empty and has no tokens; null ids,
    repeated rows and other columns of any name pass through the map or are not read. Texts
    are counted whole, whatever their length; an empty table gives an empty table.
    """

    def make():
        of = text_counter(vocabulary)

        def count(ids, texts):
            texts = [t or "" for t in texts]
            tokens = [of(t) for t in texts]
            return ids, [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]

        return count

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_rows(docs, [F.col(id_col), F.col(text_col)], schema, make)
