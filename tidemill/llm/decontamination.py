"""Documents that hold a benchmark item, whole and up to a share of edited words.

Windows of an item's number of words are embedded by a random walk (CGK): at each step the
current word is written, and a random bit of step and word tells whether to go on to the next
one. Walks over texts a few edits apart fall into step again, so their outputs differ in few
places: edit distance has become Hamming distance. Bit sampling then makes candidates: some
positions, drawn anew in each repetition, must agree. The number of repetitions follows from
the recall that is asked for. Each candidate is verified by its exact edit distance.

Windows are embedded only where an item could be at all: an edit of a word touches two of an
item's pairs of neighbours, so a stretch within the allowed edits holds all the other pairs.
This condition is exact, and it leaves few windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import by_slices, map_rows
from tidemill.llm.word_hashes import mixed, plain, word_hashes

#: Bytes of items that are searched for in one pass over the documents.
BLOCK_BYTES = 32 << 20
EDIT_SHARE = 0.2
#: Items of fewer words are searched for as they are, all words in a row.
MIN_WORDS = 5
RECALL = 0.99
#: Positions a repetition samples, and the share of positions assumed to agree at the edit limit.
SAMPLED, AGREEMENT = 2, 0.25
#: Texts whose words are searched as one array.
SLICE_ROWS = 1024
_SEED = 20


def repetitions(recall: float = RECALL, sampled: int = SAMPLED, agreement: float = AGREEMENT) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled))


class Embedding:
    """CGK walks of ``3 n`` steps over windows of ``n`` words, and their sampled keys.

    A walk takes about ``2 n`` steps to the end of its window and stays there, where any two
    agree, so positions are sampled from the first half.
    """

    def __init__(self, n: int, recall: float):
        random = np.random.default_rng([_SEED, n])
        self.n, self.steps = n, 3 * n
        self.bits = random.integers(1, 1 << 63, self.steps, dtype=np.uint64) | np.uint64(1)
        self.sampled_steps = -(-self.steps // 2)
        self.samples = random.integers(0, self.sampled_steps, (repetitions(recall), SAMPLED))

    def walk(self, windows: np.ndarray) -> np.ndarray:
        """The part of the walks that is sampled."""
        rows, place = np.arange(len(windows)), np.zeros(len(windows), np.int64)
        padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1)
        out = np.empty((len(windows), self.sampled_steps), np.uint64)
        for step in range(self.sampled_steps):
            out[:, step] = words = padded[rows, place]
            go = (mixed(words * self.bits[step]) >> np.uint64(63)).astype(np.int64)
            place = np.minimum(place + go, self.n)
        return out

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """One key for each window and repetition."""
        walks = self.walk(windows)
        keys = np.zeros((len(windows), len(self.samples)), np.uint64)
        for column in range(SAMPLED):
            keys = mixed(keys * np.uint64(3) + walks[:, self.samples[:, column]])
        return keys


def best_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between ``item`` and any stretch of ``words``, with its start and end."""
    n = len(words)
    along = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), along.copy()
    for i, word in enumerate(item, 1):
        # Cost and start travel together: of equal costs, the later start is the shorter stretch.
        kept = (cost[:-1] + (words != word)) * (n + 2) + (n + 1 - begin[:-1])
        dropped = (cost + 1) * (n + 2) + (n + 1 - begin)
        best = dropped.copy()
        best[1:] = np.minimum(best[1:], kept)
        best = np.minimum.accumulate(best - along * (n + 2)) + along * (n + 2)
        cost, begin = best // (n + 2), n + 1 - best % (n + 2)
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


class Items:
    """Benchmark items prepared for the search; those under ``MIN_WORDS`` words must occur exactly."""

    def __init__(self, items: list[tuple[object, str]], edit_share: float = EDIT_SHARE, recall: float = RECALL):
        hashes, bounds = word_hashes([plain(text) for _, text in items])
        words = [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
        self.share = edit_share
        self.by_length: dict[int, list[tuple[object, np.ndarray]]] = {}
        short: dict[int, list[tuple[object, np.ndarray]]] = {}
        for (name, _), own in zip(items, words):
            if len(own):
                (self.by_length if len(own) >= MIN_WORDS else short).setdefault(len(own), []).append((name, own))
        self.short = {}
        for n, group in short.items():
            keys = _runs(np.concatenate([own for _, own in group]), n)[::n]
            order = np.argsort(keys, kind="stable")
            self.short[n] = (keys[order], [group[i] for i in order.tolist()])
        every = [_pairs(own) for group in self.by_length.values() for _, own in group]
        self.pairs = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        self.shift = np.uint64(64 - max(16, (8 * len(self.pairs)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.pairs >> self.shift] = True
        self.own_pairs = {n: [_pairs(own).tolist() for _, own in group] for n, group in self.by_length.items()}
        self.indexes = {}
        for n, group in self.by_length.items():
            embedding = Embedding(n, recall)
            keys = embedding.keys(np.array([own for _, own in group]))
            order = np.argsort(keys, axis=0)
            self.indexes[n] = (embedding, np.take_along_axis(keys, order, 0), order)

    def edits(self, n: int) -> int:
        return int(self.share * n)

    def search(self, texts: list[str | None]) -> list[list[tuple[object, int, int, int]]]:
        """For each text ``(item, edits, first word, word after the last)`` of its items, by item order."""
        found: list[dict[int, tuple]] = [{} for _ in texts]
        words, bounds = word_hashes([plain(t) for t in texts])
        self._search_short(words, bounds, found)
        if not len(self.pairs) or len(words) < 2:
            return [[match for _, match in sorted(f.items())] for f in found]
        pairs = _pairs(words)
        maybe = np.flatnonzero(self.seen[pairs >> self.shift])
        at = np.minimum(np.searchsorted(self.pairs, pairs[maybe]), len(self.pairs) - 1)
        hits = maybe[self.pairs[at] == pairs[maybe]]
        doc = np.searchsorted(bounds, hits, side="right") - 1
        inside = hits + 1 < bounds[doc + 1]  # the pair does not cross into the next text
        hits, doc = hits[inside], doc[inside]
        order = np.argsort(pairs[hits], kind="stable")
        same = pairs[hits[order[1:]]] == pairs[hits[order[:-1]]]
        before = np.full(len(hits), -1)  # the hit before with the same pair
        before[order[1:][same]] = order[:-1][same]
        for n in self.indexes:
            self._search_length(n, words, bounds, hits, doc, before, found)
        return [[match for _, match in sorted(f.items())] for f in found]

    def _search_short(self, words, bounds, found):
        """Items under ``MIN_WORDS`` words, where all of them stand in a row; the first place of each."""
        for n, (keys, group) in self.short.items():
            if len(words) < n:
                continue
            runs = _runs(words, n)
            at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            hits = np.flatnonzero(keys[at] == runs)
            doc = np.searchsorted(bounds, hits, side="right") - 1
            inside = hits + n <= bounds[doc + 1]  # the run does not cross into the next text
            hits, doc = hits[inside], doc[inside]
            _, first = np.unique(np.stack([doc, at[hits]]), axis=1, return_index=True)
            for start, text in zip(hits[first].tolist(), doc[first].tolist()):
                i = int(at[start])
                while i < len(keys) and keys[i] == runs[start]:  # equal items
                    if np.array_equal(group[i][1], words[start : start + n]):
                        begin = start - int(bounds[text])
                        found[text][(n, i)] = (group[i][0], 0, begin, begin + n)
                    i += 1

    def _search_length(self, n, words, bounds, hits, doc, before, found):
        edits = self.edits(n)
        need = max(1, n - 1 - 2 * edits)
        if len(hits) < need:
            return
        first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
        own = doc[: len(first)]
        dense = np.flatnonzero((last - first <= n + edits - 2) & (own == doc[need - 1 :]))
        # The same holds of different pairs; a word said over and over is one.
        until = np.searchsorted(hits, hits[dense] + n + edits - 2, side="right")
        different = np.zeros(len(dense), np.int64)
        for offset in range(int((until - dense).max(initial=0))):
            at = np.minimum(dense + offset, len(hits) - 1)
            different += (dense + offset < until) & (before[at] < dense)
        dense = dense[different >= min(len(set(p)) for p in self.own_pairs[n]) - 2 * edits]
        if not len(dense):
            return
        # Starts of windows that can hold such a stretch, each once.
        low = np.maximum(last[dense] + 2 - n - edits, bounds[own[dense]])
        spans = np.stack([low, first[dense] + 1], axis=1)
        lengths = spans[:, 1] - spans[:, 0]
        starts = np.unique(np.repeat(spans[:, 0] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum()))
        embedding, keys, order = self.indexes[n]
        padded = np.concatenate([words, np.zeros(n, np.uint64)])
        for some in np.array_split(starts, -(-len(starts) // 4096)):
            where = np.searchsorted(bounds, some, side="right") - 1
            windows = padded[some[:, None] + np.arange(n)]
            windows[some[:, None] + np.arange(n) >= bounds[where + 1][:, None]] = 0
            mine = embedding.keys(windows)
            pairs = set()
            for r in range(mine.shape[1]):
                lows, highs = np.searchsorted(keys[:, r], mine[:, r]), np.searchsorted(keys[:, r], mine[:, r], "right")
                for w in np.flatnonzero(highs > lows).tolist():
                    pairs.update((w, i) for i in order[lows[w] : highs[w], r].tolist())
            if pairs:
                self._verify(n, edits, words, bounds, some, where, sorted(pairs), found)

    def _verify(self, n, edits, words, bounds, starts, where, pairs, found):
        done: dict[tuple[int, int], int] = {}
        for w, i in pairs:
            text = int(where[w])
            if starts[w] < done.get((text, i), -1):
                continue  # lies in the stretch that was verified last
            begin, end = int(bounds[text]), int(bounds[text + 1])
            low, high = max(begin, int(starts[w]) - edits), min(end, int(starts[w]) + 2 * n + edits)
            name, item = self.by_length[n][i]
            near = set(_pairs(words[low:high]).tolist())
            if sum(p in near for p in self.own_pairs[n][i]) < n - 1 - 2 * edits:
                continue  # too few of the item's pairs for this many edits
            cost, a, b = best_match(item, words[low:high])
            done[text, i] = int(starts[w]) + n
            if cost <= edits:
                key = (n, i)
                match = (name, cost, low + a - begin, low + b - begin)
                if key not in found[text] or match[1] < found[text][key][1]:
                    found[text][key] = match


def _pairs(words: np.ndarray) -> np.ndarray:
    return mixed(words[:-1] * np.uint64(0x2545F4914F6CDD1D) + words[1:])


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """One number for the ``n`` words from each place on."""
    keys = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        keys = mixed(keys * np.uint64(3) + words[i : len(words) - n + 1 + i])
    return keys


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in blocks of bounded bytes; each block is one pass over the documents."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == k)
        yield sorted(((r.item, r.text) for r in block.collect()), key=lambda r: (str(r[0]), r[1]))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", edit_share: float = EDIT_SHARE, recall: float = RECALL, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and benchmark item it holds: ids, ``edits``, ``start_word``, ``end_word``.

    A document holds an item if some stretch of its words is at most ``edit_share`` of the
    item's words away, in inserted, deleted and replaced words. Words end at ASCII white space
    and punctuation; A-Z count as lower case; of scripts written without spaces each letter or
    mark is a word, and their punctuation ends words. Of several such stretches one with the
    fewest edits is given. An item under five words allows no edit: all its words must stand in
    a row, and its first place is given. Null and empty texts hold nothing; null items and those
    without words are not looked for; repeated rows are searched each; null ids are ids like others. Whole texts of any
    length are searched in a map, without shuffle; items come in blocks of ``block_bytes``, so
    that what is broadcast does not grow with the benchmark. Other columns are not read.
    """
    spark, out = docs.sparkSession, None
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kinds[0]}, {item_col} {kinds[1]}, edits int, start_word bigint, end_word bigint"
    for block in _blocks(benchmark, item_col, "text", block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared):
            items = Items(shared.value, edit_share, recall)

            def run(ids, texts):
                rows = [(doc, *match) for doc, found in zip(ids, items.search(texts)) for match in found]
                return list(zip(*rows)) if rows else [[]] * 5

            return run

        part = map_rows(docs, [id_col, text_col], schema, make, SLICE_ROWS)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    edit_share: float = EDIT_SHARE, recall: float = RECALL, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; a map."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, "text", block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = Items(shared.value, edit_share, recall)
            for batch in by_slices(batches, SLICE_ROWS):
                found = items.search(batch.column(at).to_pylist())
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
