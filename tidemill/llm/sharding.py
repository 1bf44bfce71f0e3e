"""Shards of near-equal bytes that keep equal texts together.

Groups of equal texts are ordered by the hash of the text. A contiguous partition of this
order into a fixed number of shards is sought whose largest shard is smallest. For a given
capacity a greedy pass tells whether the shards suffice, so the smallest capacity is found by
binary search. The order itself stays on the cluster: the driver holds byte totals of ranges
of hashes and asks for finer ones only near the cuts, where they decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import kept, text_of

#: Bits of the hash by which a range is split: first, and later.
FIRST_BITS, MORE_BITS = 12, 8
#: Ranges split in one round.
SPLIT_RANGES = 48


@dataclass
class _Range:
    """Groups whose hashes share their first ``bits`` bits; ``bits`` 64: one group."""

    first: int
    last: int
    bits: int
    size: int


def minimax_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``law`` is ``bytes``: the capacity of the largest shard is the least that any contiguous
    partition of the ordered groups has. Equal texts share a shard; ``slot`` counts from 0
    without gaps in each shard; ``grown_shard`` is null under this law. Size is the UTF-8
    length plus 1, so that null or empty texts (one group) weigh 1. Null ids and repeated rows
    are rows like others; other columns are not read; an empty table gives an empty result.

    Texts are read once and not shuffled. What is sorted are four numbers a document, over
    ranges of (hash, id), so that a group with very many rows spreads over many tasks.
    """
    text = text_of(text_col)
    raw = F.encode(text, "UTF-8")
    # Read order settles ties, so that even equal rows can be dealt to several tasks.
    numbered = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text).alias("group_hash"),
        F.monotonically_increasing_id().alias("read_order"),
    )
    order = ["group_hash", id_col, "read_order"]
    rows, _ = kept(
        numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        "sized",
    )
    shard = F.lit(0)
    for cut in cuts(rows, shards):
        shard = shard + F.when(F.col("group_hash") > cut, 1).otherwise(0)
    dealt = rows.withColumns({"shard": shard.cast("int"), "part": F.shiftright("place", 33)})
    return (
        dealt.join(F.broadcast(_offsets(dealt)), ["part", "shard"])
        .select(
            id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("place") - F.col("first_place") + F.col("offset")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _offsets(dealt: DataFrame) -> DataFrame:
    """Where each task's rows start in each shard.

    There are at most as many such pairs as tasks and shards together, since both follow one
    order; the driver adds them up.
    """
    spark = dealt.sparkSession
    pairs = dealt.groupBy("shard", "part").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("n")).collect()
    out, shard, offset = [], None, 0
    for p in sorted(pairs, key=lambda p: (p.shard, p.part)):
        offset = 0 if p.shard != shard else offset
        out.append((p.part, p.shard, p.first_place, offset))
        shard, offset = p.shard, offset + p.n
    return spark.createDataFrame(out, "part bigint, shard int, first_place bigint, offset bigint")


def cuts(rows: DataFrame, shards: int) -> list[int]:
    """The last hash of each shard but the last one."""
    ranges = _split(rows, None, FIRST_BITS)
    while True:
        sizes = np.array([r.size for r in ranges], dtype=np.int64)
        whole = np.array([r.bits >= 64 for r in ranges])
        least = _capacity(sizes, whole, shards, False)
        enough = _capacity(sizes, whole, shards, True)
        if least == enough:
            ends = _greedy(sizes, whole, enough, shards, True)[1]
            return [ranges[e - 1].last for e in ends[:-1] if 0 < e < len(ranges)]
        near = set()
        for capacity in (least, (least + enough) // 2, enough):
            for strict in (False, True):
                near.update(j for e in _greedy(sizes, whole, capacity, shards, strict)[1] for j in (e - 1, e, e + 1))
        largest = lambda xs: sorted((i for i in xs if 0 <= i < len(ranges) and not whole[i]), key=lambda i: -sizes[i])
        chosen = (largest(near) or largest(range(len(ranges))))[:SPLIT_RANGES]
        bits = ranges[chosen[0]].bits
        chosen = [i for i in chosen if ranges[i].bits == bits]
        finer = _split(rows, [ranges[i] for i in chosen], min(64, bits + MORE_BITS), bits)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in set(chosen)] + finer, key=lambda r: r.first)


def _split(rows, among, bits, old_bits=0):
    """Byte totals by the first ``bits`` bits of the hash, of all rows or within some ranges."""
    if among is not None:
        rows = rows.where(F.shiftright("group_hash", 64 - old_bits).isin([r.first >> (64 - old_bits) for r in among]))
    found = (
        rows.groupBy(F.shiftright("group_hash", 64 - bits).alias("prefix"))
        .agg(F.sum("size").alias("size"), F.min("group_hash").alias("first"), F.max("group_hash").alias("last"))
        .collect()
    )
    made = [_Range(r["first"], r["last"], 64 if r["first"] == r["last"] else bits, r["size"]) for r in found]
    return sorted(made, key=lambda r: r.first)


def _greedy(sizes, whole, capacity, shards, strict):
    """Whether the shards suffice, and the index after each shard's last range.

    Ranges of several groups count as one group if ``strict``, else as if they could be cut
    anywhere: the truth lies between.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    start, ends = 0, []
    for _ in range(shards):
        i = int(np.searchsorted(total, start + capacity, side="right")) - 1
        if i >= len(sizes):
            ends.append(len(sizes))
            return True, ends
        start = total[i] if strict or whole[i] else start + capacity
        ends.append(i)
    return start >= total[-1], ends


def _capacity(sizes, whole, shards, strict):
    """The least capacity for which the greedy pass succeeds."""
    low, high = 0, int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if _greedy(sizes, whole, middle, shards, strict)[0]:
            high = middle
        else:
            low = middle + 1
    return low
