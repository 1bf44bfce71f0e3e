"""Repeated strings across a corpus, by blockwise sorting of suffixes over a difference cover.

A difference cover modulo ``v`` is a set of residues such that for any two positions some offset
below ``v`` takes both into the set. Only suffixes at cover positions are ranked first, by their
first bytes, one bucket of suffixes at a time. Two equal long strings then have, from such an
offset on, every ``v`` bytes a pair of cover suffixes of equal rank: a suffix that has no
residue along which all its cover ranks are shared by another suffix cannot begin a repeated
string. The few that remain are the long ties. They are sorted likewise, one bucket at a time,
by the names of their whole length; a bucket holds numbers only, never text, so its memory is
bounded. Texts stay in blocks of bounded bytes; what travels are names and, back, single bits.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.llm.common import by_slices, kept

# A perfect difference set; each offset below 73 is a difference of two of them.
MODULUS, COVER = 73, (0, 1, 3, 7, 15, 31, 36, 54, 63)
#: Bytes of a cover suffix that its rank is made from.
PREFIX = 64
LENGTH = 400
BLOCK_BYTES = 4 << 20
#: Bytes of text for each bucket of suffixes, and for each bucket of blocks.
SUFFIX_BUCKET_BYTES, TEXT_BUCKET_BYTES = 8 << 20, 24 << 20
MAX_BUCKET_BITS = 17
_BASE = 0xD6E8FEB86659FD93
_NAMES = "bucket int, block bigint, names binary"


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    forth, back = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    forth[0] = back[0] = 1
    return np.cumprod(forth), np.cumprod(back)


def _mixed(values):
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return values ^ (values >> np.uint64(29))


class Block:
    """Texts laid end to end, and the names of their substrings."""

    def __init__(self, data: bytes, lengths):
        self.data = np.frombuffer(data, np.uint8)
        lengths = np.asarray(lengths, np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        n = len(self.data)
        forth, self.back = _powers(1 << max(22, n.bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * forth[:n], out=self.sums[1:])

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        """64-bit names of the substrings of ``length`` bytes at the positions."""
        return _mixed((self.sums[at + length] - self.sums[at]) * self.back[at])

    def cover(self, modulus: int, cover: tuple[int, ...], prefix: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cover positions by residue, each with the number of its text."""
        out = []
        for residue in cover:
            first = self.starts + residue
            n = np.maximum(0, -(-(self.ends - prefix + 1 - first) // modulus))
            text = np.repeat(np.arange(len(n)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append((first[text] + modulus * k, text))
        return out

    def candidates(self, residues, alive, modulus: int, prefix: int, length: int) -> np.ndarray:
        """Positions whose cover suffixes along some residue are all alive, up to ``length`` bytes on."""
        change = np.zeros(len(self.data) + 2, np.int64)
        for (at, text), live in zip(residues, alive):
            if not live.any():
                continue
            joins = np.zeros(len(at) + 1, bool)
            joins[1:-1] = (text[1:] == text[:-1]) & live[1:] & live[:-1]
            first, last = np.flatnonzero(live & ~joins[:-1]), np.flatnonzero(live & ~joins[1:])
            own = text[first]
            begin, end = self.starts[own], self.ends[own]
            low, high = at[first] - modulus + 1, at[last] + modulus - (length - prefix) - 1
            low = np.where(at[first] - modulus < begin, begin, low)
            high = np.where(at[last] + modulus + prefix > end, end - length, high)
            good = low <= high
            np.add.at(change, low[good], 1)
            np.add.at(change, high[good] + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def covered(self, at: np.ndarray, length: int) -> np.ndarray:
        change = np.zeros(len(self.data) + 1, np.int64)
        change[at] += 1
        np.add.at(change, at + length, -1)
        return np.cumsum(change[:-1]) > 0


def _distinct(names):
    """The names in order, which occur more than once, and where each position's name went."""
    found, inverse, n = np.unique(names, return_inverse=True, return_counts=True)
    return found, n > 1, inverse


def _deal(block: int, names: np.ndarray, bits: int, width: int):
    """Rows of a block's ordered names by bucket; ``width`` bytes of each name are kept."""
    buckets = (names >> np.uint64(8 * width if width < 8 else 64 - bits)).astype(np.int64)
    kind = np.uint32 if width == 4 else np.uint64
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    parts = np.split(names.astype(kind), cuts) if len(names) else []
    heads = buckets[np.concatenate([[0], cuts])] if len(names) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(heads, pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
        ["bucket", "block", "names"],
    )


def _answer(width: int):
    """For one bucket of suffixes: each block's names, as bits that tell which others have too."""
    kind = np.uint32 if width == 4 else np.uint64

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, kind) for x in rows["names"].to_pylist()]
        names = np.sort(np.concatenate(parts))
        shared = np.unique(names[1:][names[1:] == names[:-1]])
        bits = []
        for part in parts:  # a block sends a name once, so a name met twice is in two blocks
            at = np.minimum(np.searchsorted(shared, part), max(0, len(shared) - 1))
            bits.append(np.packbits(shared[at] == part if len(shared) else np.zeros(len(part), bool)).tobytes())
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "bits": pa.array(bits, pa.binary())})

    return run


def _told(names: np.ndarray, bits: int, width: int, answers) -> np.ndarray:
    """The bits of a block's ordered names, put together from the buckets."""
    shared = np.zeros(len(names), bool)
    buckets = (names >> np.uint64(8 * width if width < 8 else 64 - bits)).astype(np.int64)
    for answer in answers or ():
        a, b = np.searchsorted(buckets, [answer["bucket"], answer["bucket"] + 1])
        shared[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
    return shared


class _Search:
    """What a task knows of a block after the answers it has so far."""

    def __init__(self, length, bits):
        self.length, self.bits = length, bits
        # The rank of a cover suffix: a prefix of its name as long as the bucket's bits and 32 more.
        self.cut = np.uint64(32 - bits)

    def ranks(self, block):
        residues = block.cover(MODULUS, COVER, PREFIX)
        at = np.concatenate([a for a, _ in residues])
        return residues, *_distinct(block.names(at, PREFIX) >> self.cut)

    def suffixes(self, block, answers):
        """Positions of the long ties, and their names: in order, whether repeated here, and where."""
        residues, ranks, twice, inverse = self.ranks(block)
        alive = (twice | _told(ranks, self.bits, 4, answers))[inverse]
        cuts = np.cumsum([len(a) for a, _ in residues])[:-1]
        at = block.candidates(residues, np.split(alive, cuts), MODULUS, PREFIX, self.length)
        return at, *_distinct(block.names(at, self.length))


def repeated_strings(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept_text``.

    ``kept_text`` are the remaining bytes as text; a character that lost some of its bytes is U+FFFD there.

    Removes every byte that lies in a string of ``length`` bytes which also starts at another
    place, in the same document or another one, as the input has them; strings do not cross
    documents. All of several equal places are removed. Null texts are empty; texts shorter
    than ``length`` stay whole; repeated rows are places of their own; null ids are ids like
    others; other columns are not read. Texts are UTF-8 bytes and are never cut, so that what
    remains may end within a character.

    Names are 64-bit numbers, so two different strings are taken for equal with a probability
    of about the square of the number of candidates over 2**64.
    """
    if length < PREFIX + 2 * MODULUS:
        raise ValueError(f"strings of at least {PREFIX + 2 * MODULUS} bytes, not {length}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.encode(text, "UTF-8").alias("data"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    bits = min(MAX_BUCKET_BITS, max(3, math.ceil(math.log2(1 + total / SUFFIX_BUCKET_BYTES))))
    buckets = max(1, -(-total // TEXT_BUCKET_BYTES))
    search = _Search(length, bits)

    id_type = docs.schema[id_col].dataType.simpleString()
    kind = to_arrow_type(docs.schema[id_col].dataType)
    # Bucketed, the blocks meet the answers to them without being moved.
    name = f"blocks_{uuid.uuid4().hex}"
    made = rows.mapInArrow(_blocks(block_bytes, kind), f"block bigint, ids array<{id_type}>, lengths array<int>, data binary")
    made.write.bucketBy(buckets, "block").option("compression", "zstd").saveAsTable(name)
    try:
        return _search_blocks(spark.table(name), search, buckets, id_col, id_type, kind)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _search_blocks(blocks, search, buckets, id_col, id_type, kind):
    """The result, as a table of its own; what was needed on the way is gone by then."""
    bits, length = search.bits, search.length

    def ranks(batches):
        for row, block in _read(batches):
            yield _deal(row["block"], search.ranks(block)[1], bits, 4)

    def suffixes(batches):
        for row, block in _read(batches):
            yield _deal(row["block"], search.suffixes(block, row["ranks"])[1], bits, 8)

    def result(batches):
        for row, block in _read(batches):
            at, names, twice, inverse = search.suffixes(block, row["ranks"])
            again = (twice | _told(names, bits, 8, row["suffixes"]))[inverse]
            yield _digest(row["ids"], block, block.covered(at[again], length), id_col, kind)

    first, drop_first = kept(_answers(blocks.select("block", "data", "lengths").mapInArrow(ranks, _NAMES), 4), "ranks")
    with_ranks = _with_answers(blocks, first, "ranks", buckets)
    second, drop_second = kept(_answers(with_ranks.select("block", "data", "lengths", "ranks").mapInArrow(suffixes, _NAMES), 8), "suffixes")
    both = _with_answers(with_ranks, second, "suffixes", buckets)
    schema = f"{id_col} {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    out, _ = kept(both.mapInArrow(result, schema), "removed")
    drop_first()
    drop_second()
    return out


def _blocks(block_bytes, kind):
    def run(batches):
        seen, ids, texts, size = 0, [], [], 0

        def block():
            number = (TaskContext.get().partitionId() << 33) + seen
            lengths = pa.array([[len(t) for t in texts]], pa.list_(pa.int32()))
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), lengths, pa.array([b"".join(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "lengths", "data"])

        for batch in by_slices(batches):
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size and size + len(data) > block_bytes:
                    yield block()
                    seen, ids, texts, size = seen + 1, [], [], 0
                ids.append(key)
                texts.append(data)
                size += len(data)
        if ids:
            yield block()

    return run


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Block(row.pop("data"), row["lengths"])


def _answers(names, width):
    return names.groupBy("bucket").applyInArrow(_answer(width), "block bigint, bucket int, bits binary")


def _with_answers(blocks, answers, name, buckets):
    """Blocks with the answers to them; only these are shuffled, as they are small."""
    own = answers.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    return blocks.join(own.hint("shuffle_hash"), "block", "left")


def _digest(ids, block, gone, id_col, kind):
    changes = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    sums = np.concatenate([[0], np.cumsum(gone)])
    removed = sums[block.ends] - sums[block.starts]
    spans, prints, texts = [], [], []
    for begin, end in zip(block.starts.tolist(), block.ends.tolist()):
        own = gone[begin:end]
        spans.append(int(own[:1].sum()) + int((changes[begin + 1 : end] == 1).sum()) if end > begin else 0)
        left = block.data[begin:end][~own].tobytes()
        prints.append(hashlib.sha256(left).hexdigest())
        texts.append(left.decode(errors="replace"))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array(block.ends - block.starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(prints, pa.string()), pa.array(texts, pa.string())],
        [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
    )

