"""Near duplicates by the Jaccard similarity of word shingles, every link verified on the sets.

Candidates share a band of minimum hashes or a component of SimHash fingerprints that BK-trees
find. In each such bucket one pivot is compared with all members. Members of buckets that are
not one component then are dealt into blocks of bounded size, and tasks compare two blocks at a
time by the shingles they share, so that pairs of members are no rows: what is left out are
pairs that are connected already.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import by_slices, kept, map_rows, measured_broadcast
from tidemill.llm.components import components
from tidemill.llm.simhash import fingerprint_of, keep_best, with_digest
from tidemill.llm.simhash import roots as print_roots
from tidemill.llm.word_hashes import mixed, spaced

SEED = 42
WORDS, SIMILARITY = 5, 0.8
#: Two sets of Jaccard similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Shingles whose minimum hashes are computed at once.
CHUNK = 1024
#: Members of a block, the bytes of their sets, and shared shingles that are counted at once.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
COLUMNS = 2048
_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles in order; words are those of ``simhash.fingerprint``, and each
    letter of a script without spaces.

    A text of fewer words is one shingle, one without words has none.
    """
    found = spaced(text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    n = max(1, len(found) - words + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the set's minimum hashes; the empty set has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[start : start + CHUNK, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = _BAND
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(3) + row)
    return keys.view(np.int64)


def _node(hashes):
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _alike(a, b, least):
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common)


def _verified(pairs, sets, similarity):
    """The pairs whose sets are similar enough; a set that very many pairs have is split as a skewed join."""
    least = Fraction(str(similarity))

    def run(batches):
        for batch in by_slices(batches):
            left, right = ([np.frombuffer(v, np.uint64) for v in batch.column(i).to_pylist()] for i in (2, 3))
            passed = [_alike(a, b, least) for a, b in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array(passed, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b"
    )
    return both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def dealt(live: DataFrame, sets: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(bucket, x, y, node, root, hashes)``: the members of two blocks of a bucket have ``x`` and ``y`` in common.

    A bucket's largest component is in blocks of its own, which meet those of the others but not
    each other. So rows grow with the square only of the members outside of it, and that divided
    by a block's size.
    """
    spelled = live.join(sets.select("node", "hashes"), "node")
    sizes = spelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("hashes")).alias("bytes"))
    total = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "bytes", "root")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    )
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / block_rows), F.ceil(size / block_bytes)).cast("int")
    shape = total.select(
        "bucket", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("m"),
        blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("r"),
    )
    shape, _ = kept(shape, "shape")
    placed = spelled.join(measured_broadcast(shape, F.lit(40)), "bucket").withColumn(
        "own", F.expr("int(pmod(xxhash64(node), if(root = main, m, r)))")
    )
    meets = F.expr("""if(root = main,
        transform(sequence(0, r - 1), j -> struct(-1 - own as x, j as y)),
        concat(transform(sequence(0, m - 1), i -> struct(-1 - i as x, own as y)),
               transform(filter(sequence(0, r - 1), j -> j <> own), j -> struct(least(own, j) as x, greatest(own, j) as y))))""")
    return placed.withColumn("meets", F.explode(meets)).select("bucket", "meets.x", "meets.y", "node", "root", "hashes")


def similar_pairs(sets: list[np.ndarray], least: Fraction) -> np.ndarray:
    """Which of some sets are similar enough, as a matrix; exact counts of what they share."""
    lengths = np.array([len(s) for s in sets], np.int64)
    values, inverse, places = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(places > 1) - 1
    seen = places[inverse] > 1
    rows, columns = np.repeat(np.arange(len(sets)), lengths)[seen], number[inverse[seen]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        a, b = np.searchsorted(columns, [start, start + COLUMNS])
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[rows[a:b], columns[a:b] - start] = 1
        common += holds @ holds.T  # whole numbers below 2**24
    common = common.astype(np.int64)
    return common * least.denominator >= least.numerator * (lengths[:, None] + lengths - common)


def _compare(similarity):
    """Links that connect what is similar in one group of ``dealt``, no more of them than members."""
    least = Fraction(str(similarity))

    def run(group: pa.Table) -> pa.Table:
        nodes, roots = group["node"].to_numpy(), group["root"].to_numpy()
        left, right = [], []
        if len(nodes) > 1 and (roots != roots[0]).any():
            alike = similar_pairs([np.frombuffer(v, np.uint64) for v in group["hashes"].to_pylist()], least)
            alike |= roots[:, None] == roots
            waits = np.ones(len(nodes), bool)
            for seed in range(len(nodes)):
                todo = [seed] if waits[seed] else []
                waits[seed] = False
                while todo:
                    at = todo.pop()
                    found = np.flatnonzero(alike[at] & waits)
                    waits[found] = False
                    todo += found.tolist()
                    new = found[roots[found] != roots[at]]
                    left += [nodes[at]] * len(new)
                    right += nodes[new].tolist()
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def similar_links(
    members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(node, root)`` of what verified links of ``members(bucket, node)`` connect.

    A pair in a bucket is not compared only if its ends are connected already.
    """
    chosen, drop_chosen = kept(members.groupBy("bucket").agg(F.min("node").alias("pivot")), "pivots")
    pairs = members.join(chosen, "bucket").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    found, _ = kept(_verified(pairs, sets, similarity), "links")
    drop_chosen()
    roots, drop_roots = kept(components(found), "roots")
    state, drop_state = kept(
        members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "state"
    )
    open_ones = state.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    live, drop_live = kept(state.join(open_ones.select("bucket"), "bucket", "left_semi"), "live")
    drop_state(), drop_roots()
    groups = dealt(live, sets, block_rows, block_bytes).groupBy("bucket", "x", "y")
    more, _ = kept(groups.applyInArrow(_compare(similarity), "a bigint, b bigint"), "links")
    drop_live()
    out, _ = kept(components(found.union(more)), "roots")
    return out


def keep_one_of_similar(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each component, with all its columns: the one of the smallest id.

    Components are chains of documents of which neighbours have at least this Jaccard
    similarity of their sets of shingles. Every link is verified exactly; what is missed are
    pairs that share none of the bands and that no chain of SimHash fingerprints connects.
    Equal sets are one node before anything is compared.
    Texts without words are copies of each other. Rows are told apart as in
    ``simhash.keep_one_of_each``.
    """
    columns, named = docs.columns, with_digest(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def mark():
        def run(rows, ids, texts):
            sets = [shingle_set(t, words) for t in texts]
            prints = np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
            return rows, ids, [_node(s) for s in sets], prints, [bands(s).tolist() for s in sets]

        return run

    def spell():
        return lambda nodes, texts: (nodes, [shingle_set(t, words).tobytes() for t in texts])

    marked, _ = kept(
        map_rows(named, ["_row", id_col, text_col], f"_row string, `{id_col}` {kind}, node bigint, print bigint, bands array<bigint>", mark),
        "marked",
    )
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    distinct, drop_distinct = kept(marked.groupBy("node").agg(F.min(order).alias("best"), F.first("print").alias("print"), F.first("bands").alias("bands")), "distinct")
    spread = distinct.join(print_roots(distinct.select("print").distinct()), "print", "left").where("size(bands) > 0")
    every = distinct.select("node", F.explode("bands").alias("bucket")).union(spread.select("node", F.coalesce("root", "print")))
    shared = every.groupBy("bucket").count().where("count > 1").select("bucket")
    members, drop_members = kept(every.join(shared, "bucket", "left_semi").select("bucket", "node"), "members")
    wanted = distinct.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("best.row").alias("_row"))
    texts = named.select("_row", text_col).join(measured_broadcast(wanted, F.lit(104)), "_row")
    sets, drop_sets = kept(map_rows(texts, ["node", text_col], "node bigint, hashes binary", spell).dropDuplicates(["node"]), "sets")
    linked = distinct.join(similar_links(members, sets, similarity), "node", "left")
    best, _ = kept(linked.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")), "best")
    drop_members(), drop_sets(), drop_distinct()
    return keep_best(named, columns, marked, best)
