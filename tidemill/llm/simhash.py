"""Near duplicates by SimHash fingerprints, found in BK-trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import kept, map_rows, measured_broadcast
from tidemill.llm.components import components

SEED = 42
#: Nodes above which a shard is split by more bits.
MAX_TREE = 512
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it set; no words: 0.

    A-Z count as lower case, words end at ASCII white space, shingles count as often as they
    occur, and a text of fewer words is one shingle.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    return fingerprint_of(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n))


def fingerprint_of(hashes: np.ndarray) -> int:
    """64 bits, each set if more than half of the hashes have it set; no hashes: 0."""
    n = len(hashes)
    counts = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", words: int = 3) -> DataFrame:
    """``carry`` and ``print``, the fingerprint as a signed number; a map."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def make():
        def run(*columns):
            values = np.array([fingerprint(t, words) for t in columns[-1]], np.uint64)
            return [*columns[:-1], values.view(np.int64)]

        return run

    return map_rows(docs, [*(F.col(c) for c in carry), F.col(text_col)], f"{kinds}, print bigint", make)


class BkTree:
    """Children of a node are keyed by their distance to it.

    What lies within the radius of a value can only hang on edges whose key differs from the
    value's distance to the node by the radius at most. ``add`` links a value to one member of
    each set of nodes it touches, so that n values get n - 1 links at most, and stops when all
    nodes are one set with it.
    """

    def __init__(self, radius: int):
        self.radius, self.root, self.parent, self.sets = radius, None, {}, 0

    def _top(self, value):
        parent = self.parent
        while parent[value] != value:
            parent[value] = parent[parent[value]]
            value = parent[value]
        return value

    def add(self, value: int) -> list[int]:
        links, self.parent[value] = [], value
        if self.root is not None:
            links = self._search(value)
        self.sets += 1 - len(links)
        if self.root is None:
            self.root = (value, {})
            return links
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (value, {})
                return links
            node = child

    def _search(self, value):
        links, radius, open_nodes = [], self.radius, [self.root]
        while open_nodes:
            found, children = open_nodes.pop()
            distance = (found ^ value).bit_count()
            if distance <= radius and (top := self._top(found)) != self._top(value):
                self.parent[top] = self._top(value)
                links.append(found)
                if len(links) == self.sets:
                    break
            for key, child in children.items():
                if distance - radius <= key <= distance + radius:
                    open_nodes.append(child)
        return links


def near_links(prints: DataFrame, radius: int = 3, max_tree: int = MAX_TREE) -> DataFrame:
    """Links ``(a, b)`` that connect what is within the radius, of distinct ``prints(print)``.

    Two fingerprints within the radius agree in one of ``radius + 1`` blocks of bits, so each
    block's value makes a shard with a tree of its own; a shard of more than ``max_tree`` nodes
    is split likewise by the other bits. A shard's tree is made where its rows are dealt to
    instead of being broadcast, as shards grow with the data. Each shard yields a spanning
    forest of its links: chains through it connect the same fingerprints as all pairs would.
    """
    blocks = radius + 1
    width = 64 // blocks
    spans = [(i * width, width if i < radius else 64 - i * width) for i in range(blocks)]
    sharded = prints.select("print", F.explode(F.array(*[_key(F.col("print"), i, s) for i, s in enumerate(spans)])).alias("shard"))
    crowded, drop = kept(sharded.groupBy("shard").count().where(F.col("count") > max_tree).select("shard"), "crowded")
    large = measured_broadcast(crowded.withColumn("large", F.lit(True)), F.lit(32))
    split = F.lit(None).cast("array<string>")
    for i, (low, n) in enumerate(spans):
        inner, step = 64 - n, (64 - n) // blocks
        rest = _bits(F.col("print"), low + n, 64 - low - n)
        rest = (F.shiftleft(rest, low) if low else rest).bitwiseOR(_bits(F.col("print"), 0, low) if low else F.lit(0))
        parts = [(j * step, step if j < radius else inner - j * step) for j in range(blocks)]
        keys = F.array(*[F.concat_ws("/", "shard", _key(rest, j, p)) for j, p in enumerate(parts)])
        split = F.when(F.col("shard").startswith(f"{i}:"), keys).otherwise(split)
    finer = sharded.join(large, "shard", "left").select(
        "print", F.explode(F.when(F.col("large"), split).otherwise(F.array("shard"))).alias("shard")
    )

    def run(batches):
        tree, current = None, None
        for batch in batches:
            left, right = [], []
            for value, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != current:
                    tree, current = BkTree(radius), shard
                links = tree.add(value & _ALL)
                left += [value] * len(links)
                right += [link - (1 << 64) if link >> 63 else link for link in links]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    found = finer.repartition("shard").sortWithinPartitions("shard", "print").mapInArrow(run, "a bigint, b bigint")
    return found.distinct()


def _bits(value, low, n):
    if n >= 64:
        return value
    moved = F.shiftrightunsigned(value, low) if low else value
    return moved.bitwiseAND(F.lit((1 << n) - 1)) if n else F.lit(0).cast("bigint")


def _key(value, i, span):
    return F.concat(F.lit(f"{i}:"), _bits(value, *span).cast("string"))


def roots(prints: DataFrame, radius: int = 3, max_tree: int = MAX_TREE) -> DataFrame:
    """``(print, root)`` of those of the distinct ``prints`` that are linked to another."""
    links, drop = kept(near_links(prints, radius, max_tree), "near")
    found, _ = kept(components(links), "roots")
    drop()
    return found.withColumnRenamed("node", "print")


def simhash_components(
    docs: DataFrame, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text",
    max_tree: int = MAX_TREE,
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id among the documents that chains of fingerprints within
    the radius connect. Equal fingerprints are one row before anything is compared, so a group
    of copies of any size costs one. Texts without words, null ones too, have fingerprint zero
    and are linked like others. Null ids are rows like others, but never the smallest; a
    component of such rows only has a null id. Repeated rows stay; other columns are not read.
    """
    marked, _ = kept(fingerprints(docs, [id_col], text_col, words), "prints")
    distinct, _ = kept(marked.groupBy("print").agg(F.min(id_col).alias("first_id")), "distinct")
    linked = distinct.join(roots(distinct.select("print"), radius, max_tree), "print", "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("root")
    )
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels, _ = kept(linked.join(smallest, "root").select("print", "component_id"), "labels")
    return marked.join(labels, "print").select(
        id_col, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(
    docs: DataFrame, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each component, with all its columns: the one of the smallest id.

    Rows are told apart by a digest of all their columns, since ids may repeat or be null; of
    rows that are equal throughout one stays. Rows to drop are joined by that digest: by
    broadcast where they were measured to be few, otherwise by a shuffle.
    """
    columns, named = docs.columns, with_digest(docs)
    marked, _ = kept(fingerprints(named, ["_row", id_col], text_col, words), "prints")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    distinct, _ = kept(marked.groupBy("print").agg(F.min(order).alias("best")), "distinct")
    linked = distinct.join(roots(distinct.select("print"), radius), "print", "left")
    best = linked.groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("best").alias("best"))
    return keep_best(named, columns, marked, best)


def with_digest(docs: DataFrame) -> DataFrame:
    """``docs`` and ``_row``, a digest of all columns."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])), 256)
    return docs.withColumn("_row", digest)


def keep_best(named: DataFrame, columns: list[str], marked: DataFrame, best: DataFrame) -> DataFrame:
    """Of the rows ``marked(_row)`` those of ``best(best.row)``, once each."""
    rows = marked.groupBy("_row").count()
    fate = rows.join(best.select(F.col("best.row").alias("_row"), F.lit(True).alias("chosen")), "_row", "left")
    doomed, _ = kept(fate.where("chosen is null or count > 1").select("_row", F.col("chosen").isNull().alias("drop")), "doomed")
    few = lambda df: measured_broadcast(df, F.lit(96))
    stay = named.join(few(doomed.where("drop").select("_row")), "_row", "left_anti")
    repeated = doomed.where("not drop").select("_row")
    if repeated.isEmpty():
        return stay.select(*columns)
    once = named.join(few(repeated), "_row", "left_semi").dropDuplicates(["_row"])
    return stay.join(few(repeated), "_row", "left_anti").unionByName(once).select(*columns)
