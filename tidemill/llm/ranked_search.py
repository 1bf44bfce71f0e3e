"""The best documents of every query item, found by range maxima of posting lists.

Documents are indexed in segments of bounded size, wherever they lie: one list of postings for
each term of the items, in order of document. What a term adds to a document's score does not
depend on the item, so a list carries these impacts and a sparse table of its range maxima. The
sum of an item's maxima bounds every score in an interval of documents. The search takes the
intervals of highest bound first, scores the document that holds the largest single impact
exactly, and goes on with the intervals on both sides of it, until no interval can hold one of
the best any more.
"""

from __future__ import annotations

import gc
import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemill.llm.common import by_slices, kept, text_of

#: A segment ends after so many documents or postings, whichever comes first.
SEGMENT_DOCS, SEGMENT_POSTINGS = 16_384, 1 << 20
#: Items searched at once in a segment.
GROUP = 64
#: Rounds of a first search of all segments; the scores it finds bound from below what the best documents score.
FIRST_ROUNDS = 5
#: Bytes of items that one pass over the documents takes.
BLOCK_BYTES = 8 << 20
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20
# What is no part of a term, once A-Z are in lower case.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Length normalisation in per cent, saturation in tenths of the parameter 1.25 ... of the scoring rule.
_LENGTH_SHARE, _SATURATION, _SCALE = 90, 8, 1_000_000_000


def term_counts(text: str | None, number_of) -> tuple[int, Counter]:
    """How many terms a text has, and how often those with a number occur."""
    plain = (text or "").encode().translate(_PLAIN)
    n, counts, at = 0, Counter(), 0
    while at < len(plain):
        end = at + CHUNK
        if end < len(plain):
            space = plain.find(b" ", end)
            end = len(plain) if space < 0 else space
        words = plain[at:end].split()
        n += len(words)
        counts.update(map(number_of, words))
        at = end
    counts.pop(None, None)
    return n, counts


class Segment:
    """Posting lists of some documents, numbered in the order that settles ties."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.n_docs = n_docs
        keys = term.astype(np.int64) * n_docs + doc
        order = np.argsort(keys, kind="stable")
        self.keys, self.impact = keys[order], impact[order]
        self.doc = doc[order].astype(np.int32)
        lengths = np.bincount(term, minlength=n_terms)
        self.first, longest = np.concatenate([[0], np.cumsum(lengths)]), int(lengths.max(initial=1))
        # tops[k][i]: the first place of the largest impact among the 2**k postings from i on
        self.tops = np.empty((max(1, longest.bit_length()), len(keys)), np.int32)
        self.tops[0] = np.arange(len(keys))
        for k in range(1, len(self.tops)):
            left, half = self.tops[k - 1], 1 << (k - 1)
            right = left[half:]
            better = self.impact[right] > self.impact[left[: len(right)]]
            self.tops[k] = left
            self.tops[k, : len(right)][better] = right[better]

    def top(self, start, end):
        """Places of the largest impacts within ranges of postings of one list, none of them empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        left, right = self.tops[level, start], self.tops[level, end - (1 << level.astype(np.int64))]
        return np.where(self.impact[right] > self.impact[left], right, left)

    def search(self, items: list[np.ndarray], floors: np.ndarray, k: int, rounds: int | None = None):
        """``(item, doc, score)`` of each item's ``k`` best of those that score its floor or more.

        Of equal scores the lower document comes first. With ``rounds`` the search may end early,
        with true scores that need not be the best.
        """
        parts = [self._search(items[i : i + GROUP], floors[i : i + GROUP], k, rounds) for i in range(0, len(items), GROUP)]
        shifted = [(item + n * GROUP, doc, score) for n, (item, doc, score) in enumerate(parts)]
        return [np.concatenate(x) for x in zip(*shifted)]

    def _search(self, items, floors, k, rounds):
        """Rounds take an item's best intervals, in growing numbers, so there are few, each over long arrays.

        An interval has an entry for each of the item's lists with postings in it: their range.
        """
        none = np.empty(0, np.int64)
        best, floor, last = (none, none, none), np.maximum(floors, 1), np.full(len(items), self.n_docs, np.int64)
        owner = np.repeat(np.arange(len(items)), list(map(len, items)))
        wanted = np.concatenate(items) if items else none
        found = self._intervals(owner, self.first[wanted], self.first[wanted + 1])
        item, (low, high), width = found[0], (np.zeros_like(found[0]), np.full_like(found[0], self.n_docs)), 2
        bound, split, at, count, starts, ends = found[1:]
        while True:
            able = (bound > floor[item]) | ((bound == floor[item]) & (low < last[item]))
            able = np.flatnonzero(able)
            if not len(able) or rounds == 0:
                return best
            rounds = rounds - 1 if rounds else None
            order = able[np.lexsort((low[able], -bound[able], item[able]))]
            now = _rank(item[order]) < width
            chosen, rest, width = order[now], order[~now], width * 2
            n, middle, who = len(chosen), split[chosen], item[chosen]
            entry = np.repeat(at[chosen] - np.cumsum(count[chosen]) + count[chosen], count[chosen]) + np.arange(count[chosen].sum())
            start, end = starts[entry], ends[entry]
            owner = np.repeat(np.arange(n), count[chosen])
            cut = np.searchsorted(self.keys, self.keys[start] - self.doc[start] + middle[owner])
            place = np.minimum(cut, len(self.keys) - 1)
            hit = (cut < end) & (self.doc[place] == middle[owner])
            score = np.add.reduceat(np.where(hit, self.impact[place], 0), np.concatenate([[0], np.cumsum(count[chosen])[:-1]]))
            best = _best(*(np.concatenate(x) for x in zip(best, (who, middle, score))), floor, k)
            full = _rank(best[0]) == k - 1
            floor[best[0][full]], last[best[0][full]] = best[2][full], best[1][full]
            # the intervals on both sides
            found = self._intervals(
                np.concatenate([owner, owner + n]), np.concatenate([start, cut + hit]), np.concatenate([cut, end])
            )
            side, parent = found[0] >= n, found[0] % n
            item = np.concatenate([item[rest], who[parent]])
            low, high = (
                np.concatenate([low[rest], np.where(side, middle[parent] + 1, low[chosen][parent])]),
                np.concatenate([high[rest], np.where(side, high[chosen][parent], middle[parent])]),
            )
            bound, split, count = (np.concatenate([x[rest], y]) for x, y in ((bound, found[1]), (split, found[2]), (count, found[4])))
            at = np.concatenate([at[rest], found[3] + len(starts)])
            starts, ends = np.concatenate([starts, found[5]]), np.concatenate([ends, found[6]])

    def _intervals(self, owner, start, end):
        """Of intervals given by their entries: those with postings, the sums of the lists' maxima,
        the documents of the largest, where their entries begin and how many, and the entries."""
        some = end > start
        owner, start, end = owner[some], start[some], end[some]
        if not len(owner):
            return [np.empty(0, np.int64)] * 7
        place = self.top(start, end)
        value, doc = self.impact[place], self.doc[place].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        count = np.diff(np.concatenate([at, [len(owner)]]))
        doc[value < np.repeat(np.maximum.reduceat(value, at), count)] = -1
        return owner[at], np.add.reduceat(value, at), np.maximum.reduceat(doc, at), at, count, start, end


def _rank(sorted_values):
    """Places within runs of equal values, from 0."""
    n = len(sorted_values)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if n else np.empty(0, np.int64)
    return np.arange(n) - np.repeat(starts, np.diff(np.concatenate([starts, [n]])))


def _best(item, doc, score, floor, k):
    order = np.lexsort((doc, -score, item))
    order = order[score[order] >= floor[item[order]]]
    order = order[_rank(item[order]) < k]
    return item[order], doc[order], score[order]


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item, terms)``: the distinct terms of each item that has any, rows of one item taken together."""
    terms = F.regexp_extract_all(F.translate(text_of(text_col), _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    return (
        items.select(F.col(item_col).alias("item"), F.explode(terms).alias("term"))
        .groupBy("item")
        .agg(F.sort_array(F.collect_set("term")).alias("terms"))
    )


def _blocks(items: DataFrame, block_bytes: int):
    """The items in blocks of bounded bytes."""
    items, drop = kept(items, "items")
    weight = F.octet_length(F.array_join("terms", " ")) + 64
    blocks = max(1, -(-items.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] // block_bytes))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == k).collect()
        if block:
            yield sorted(((r.item, r.terms) for r in block), key=str)
    drop()


def _segments(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """The postings of the given terms, in segments; documents without any of them are only counted."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(
        f"ids array<{id_type}>, lengths array<bigint>, doc array<int>, term array<int>, tf array<int>,"
        " holders array<bigint>, n_docs bigint, n_terms bigint"
    )
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        gc.set_threshold(200_000, 50, 100)  # as in map_rows
        number_of = {t.encode(): i for i, t in enumerate(shared.value)}
        ids, lengths, post, n_docs, n_terms = [], array("q"), [array("i") for _ in range(3)], 0, 0

        def flush():
            doc, term, tf = (np.frombuffer(x, np.int32) if x else np.empty(0, np.int32) for x in post)
            holders = np.bincount(term, minlength=len(number_of))
            row = (ids, np.array(lengths, np.int64), doc, term, tf, holders, n_docs, n_terms)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

        for batch in by_slices(batches):
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                n, counts = term_counts(text, number_of.get)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                if counts:
                    post[0].extend([len(ids)] * len(counts))
                    post[1].extend(counts.keys())
                    post[2].extend(counts.values())
                    ids.append(doc_id)
                    lengths.append(n)
            if len(ids) >= SEGMENT_DOCS or len(post[0]) >= SEGMENT_POSTINGS:
                yield flush()
                ids, lengths, post, n_docs, n_terms = [], array("q"), [array("i") for _ in range(3)], 0, 0
        if n_docs:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _searched(segments: DataFrame, shared, k: int, id_type: str, item_type: str, id_col: str, item_col: str) -> DataFrame:
    """Each task's best documents of every item; what earlier segments of a task gave is a floor for later ones."""
    schema = StructType.fromDDL(f"{item_col} {item_type}, {id_col} {id_type}, score bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        items, terms, weights, all_docs, all_terms, floors, rounds = shared.value
        best, floors = [[] for _ in items], floors.copy()
        first = lambda pair: (-pair[0], pair[1] is not None, pair[1])
        for batch in batches:
            for row in batch.to_pylist():
                ids = row["ids"]
                if not ids:
                    continue
                order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
                number = np.empty(len(ids), np.int64)
                number[order] = np.arange(len(ids))
                doc, term, tf = (np.array(row[c], np.int64) for c in ("doc", "term", "tf"))
                measure = 100 - _LENGTH_SHARE + _LENGTH_SHARE * np.array(row["lengths"], np.int64) * all_docs // all_terms
                impact = weights[term] * ((_SCALE * tf) // (1000 * tf + _SATURATION * measure[doc]))
                segment = Segment(len(ids), number[doc], term, impact, len(weights))
                for i, d, score in zip(*(x.tolist() for x in segment.search(terms, floors, k, rounds))):
                    best[i].append((score, ids[order[d]]))
                for i, found in enumerate(best):
                    found.sort(key=first)
                    del found[k:]
                    if len(found) == k:
                        floors[i] = max(floors[i], found[-1][0])
        rows = [(items[i], d, score) for i, found in enumerate(best) for score, d in found]
        for at in range(0, len(rows), 8192):
            columns = zip(*rows[at : at + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, arrow)], schema=arrow)

    columns = ["ids", "lengths", "doc", "term", "tf"]
    return segments.select(*columns).mapInArrow(run, schema)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best documents of every item: item id, ``rank`` from 1, document id, ``score``.

    Terms are runs of digits, ASCII letters and all other characters beyond ASCII, A-Z in lower
    case. A term weighs the logarithm of how rare it is among all documents that have terms; its
    occurrences count with saturation and are measured by the document's length against the mean.
    Only scores above 0 rank; equal scores rank by ascending document id, null ids first.

    Null and empty texts have no terms and are not counted. Rows with one item id, null
    included, are one item with the terms of all its texts; items without terms give no rows.
    Repeated documents are documents each. Empty tables give no rows. Other columns are not
    read. Texts are read whole and in place, once for each block of items of ``block_bytes``;
    their postings are kept in segments of bounded size in the shared folder, and every row of
    the result left a task that found it among the best of all it had seen.
    """
    out = None
    item_type = items.schema[item_col].dataType.simpleString()
    id_type = docs.schema[id_col].dataType.simpleString()
    for block in _blocks(item_terms(items, item_col, item_text_col), block_bytes):
        part = _block_search(docs, block, k, id_col, text_col, item_col, id_type, item_type)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"{item_col} {item_type}, rank int, {id_col} {id_type}, score bigint")
    return out


def _block_search(docs, block, k, id_col, text_col, item_col, id_type, item_type):
    context = docs.sparkSession.sparkContext
    vocabulary = sorted({t for _, terms in block for t in terms})
    number_of = {t: i for i, t in enumerate(vocabulary)}
    segments, _ = kept(_segments(docs, id_col, text_col, vocabulary), "segments")
    total = segments.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_docs", "n_terms")]).first()
    holders = dict(segments.select(F.posexplode("holders").alias("t", "n")).groupBy("t").agg(F.sum("n")).collect())
    weigh = lambda df: math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df + 1)))
    weights = np.array([weigh(holders.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    terms = [np.array([number_of[t] for t in found], np.int64) for _, found in block]
    names = [item for item, _ in block]

    def best(floors, rounds):
        shared = context.broadcast((names, terms, weights, *total, floors, rounds))
        order = Window.partitionBy(item_col).orderBy(F.col("score").desc(), F.col(id_col).asc_nulls_first())
        found = _searched(segments, shared, k, id_type, item_type, id_col, item_col)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    floors, at = np.zeros(len(names), np.int64), {name: i for i, name in enumerate(names)}
    for name, score in best(floors, FIRST_ROUNDS).where(F.col("rank") == k).select(item_col, "score").collect():
        floors[at[name]] = score
    return best(floors, None).select(item_col, "rank", id_col, "score")
