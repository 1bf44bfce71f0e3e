"""Joins of intervals that overlap, and joins on two inequalities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.errors import SpecError
from tidemill.operators.pair_totals import pair_totals
from tidemill.session import materialize

#: Rows of one side that are compared at once with as many of the other.
BLOCK_ROWS = 32_768
#: Pairs that leave a task at once.
OUTPUT_ROWS = 65_536
# The inequalities of a join, with whether a larger left value is wanted and whether equal ones match.
_SIGNS = {"<": (False, False), "<=": (False, True), ">": (True, False), ">=": (True, True)}
# On which side of equal values the border between matching and other ones lies.
_BORDER = {(False, False): "left", (False, True): "right", (True, False): "right", (True, True): "left"}
_LEAST_CLASS = -1074  # of intervals without width


def overlap_join(
    left: DataFrame, right: DataFrame, left_interval: tuple[str, str], right_interval: tuple[str, str], totals: dict[str, tuple] | None = None
) -> DataFrame:
    """Pairs of closed intervals of numbers that have a point in common, as two equi-joins.

    Intervals are classed by the power of two next above their width. A pair meets in the class of
    its wider interval, whose axis is cut into buckets of that width, so each of both lies in two
    buckets at most. A row therefore goes to its own class with all narrower rows of the other
    side, and to each wider class of the other side, of which there are no more than numbers have
    exponents. The pair is taken in the bucket of the point where it begins, once. What meets in a
    bucket is near each other, and a crowded bucket is split by the adaptive skew join. Intervals
    with a null bound or an upper bound below the lower one have no points. With ``totals`` over the
    right rows, the left rows that have pairs are returned with these, and no pair is made
    (``pair_totals``).
    """
    if totals is not None:
        left, right = (df.where(F.col(low) <= F.col(high)) for df, (low, high) in ((left, left_interval), (right, right_interval)))
        return inequality_join(left, right, (left_interval[0], "<=", right_interval[1]), (left_interval[1], ">=", right_interval[0]), totals=totals)
    sides = []
    for df, (low, high), letter in ((left, left_interval, "l"), (right, right_interval, "r")):
        width = F.col(high).cast("double") - F.col(low).cast("double")
        size = F.when(width > 0, F.ceil(F.log2(width))).otherwise(F.lit(_LEAST_CLASS)).cast("int")
        bounds = {f"_{letter}_low": F.col(low).cast("double"), f"_{letter}_high": F.col(high).cast("double"), f"_{letter}_class": size}
        sides.append(materialize(df.where(F.col(low) <= F.col(high)).withColumns(bounds), "intervals"))
    classes = [sorted(r[0] for r in s.select(f"_{x}_class").distinct().collect()) for s, x in zip(sides, "lr")]

    def cells(letter, wider):
        """The side's rows in the buckets of some classes: their own, or the wider ones given."""
        df, own = sides[letter == "r"], F.col(f"_{letter}_class")
        if wider is None:
            df = df.withColumn("_class", own)
        else:
            above = F.filter(F.array(*map(F.lit, wider)).cast("array<int>"), lambda c: (c > own) if letter == "l" else (c >= own))
            df = df.withColumn("_class", F.explode(above))
        low, high = _bucket(F.col(f"_{letter}_low")), _bucket(F.col(f"_{letter}_high"))
        # A width that was rounded down to a power of two can reach a third bucket.
        return df.withColumn("_bucket", F.explode(F.array_distinct(F.array(low, F.least(low + 1, high), high))))

    begins = F.greatest("_l_low", "_r_low")
    out = None
    for a, b in ((cells("l", None), cells("r", classes[0])), (cells("l", classes[1]), cells("r", None))):
        meet = (a[left_interval[0]] <= b[right_interval[1]]) & (b[right_interval[0]] <= a[left_interval[1]])
        pairs = a.join(b, ["_class", "_bucket"]).where(meet & (_bucket(begins) == F.col("_bucket"))).select(
            *[a[c] for c in left.columns], *[b[c] for c in right.columns]
        )
        out = pairs if out is None else out.union(pairs)
    return out


def _bucket(at):
    step = F.pow(F.lit(2.0), F.col("_class"))
    return F.when(F.col("_class") > _LEAST_CLASS, F.floor(at / step).cast("double")).otherwise(at)


def inequality_join(
    left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], block_rows: int = BLOCK_ROWS,
    totals: dict[str, tuple] | None = None,
) -> DataFrame:
    """Pairs of rows for which two inequalities hold, each ``(left column, sign, right column)``.

    Both sides are sorted by their first column and cut into blocks. Of all pairs of blocks, those
    are dropped in which no rows can match by the least and greatest values of both columns. In the
    others a task enters left rows into an array of bits in order of the second column, and reads
    the bits up to each right row's place in the first. A task holds two blocks and passes its pairs
    on in slices. The driver sees one line of bounds a block. Rows with a null or NaN in a column
    of an inequality match nothing; columns may be numbers, dates, timestamps or texts. With
    ``totals`` over the right rows, the left rows that have pairs are returned with these, and no
    pair is made (``pair_totals``).
    """
    if first[1] not in _SIGNS or second[1] not in _SIGNS:
        raise SpecError(f"inequalities are written {', '.join(_SIGNS)}")
    sides = []
    for df, x, y in ((left, first[0], second[0]), (right, first[2], second[2])):
        for c in (x, y):
            df = df.where(F.col(c).isNotNull())
            if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
                df = df.where(~F.isnan(c))
        sides.append(df if totals is not None else materialize(_blocks(df, x, y, block_rows), "blocks"))
    if totals is not None:
        return pair_totals(*sides, first, second, (_SIGNS[first[1]], _SIGNS[second[1]]), totals, block_rows)
    bounds = ["block", "low_x", "high_x", "low_y", "high_y"]
    near = _pairs(*[[r for r in s.select(*bounds).collect()] for s in sides], _SIGNS[first[1]], _SIGNS[second[1]])
    spark = left.sparkSession
    pairs = spark.createDataFrame(near, "left_block bigint, right_block bigint")
    both = pairs.join(sides[0].select(F.col("block").alias("left_block"), F.col("data").alias("left_data")), "left_block").join(
        sides[1].select(F.col("block").alias("right_block"), F.col("data").alias("right_data")), "right_block"
    )
    fields = [*left.schema, *right.schema]  # whose names may clash
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    arrow = to_arrow_schema(schema)
    at = [(left.columns.index(first[0]), left.columns.index(second[0])), (right.columns.index(first[2]), right.columns.index(second[2]))]

    def run(batches):
        for batch in batches:
            for one, other in zip(batch.column("left_data"), batch.column("right_data")):
                tables = [pa.ipc.open_stream(x.as_py()).read_all() for x in (one, other)]
                values = [[_comparable(t.column(c)) for c in places] for t, places in zip(tables, at)]
                for i, j in _matches(*values, _SIGNS[first[1]], _SIGNS[second[1]]):
                    taken = [c for t, rows in zip(tables, (i, j)) for c in t.take(pa.array(rows)).columns]
                    columns = [c.combine_chunks().cast(f.type) for c, f in zip(taken, arrow)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return both.select("left_data", "right_data").mapInArrow(run, schema).toDF(*[f.name for f in fields])


def _blocks(df, x, y, block_rows):
    """``df`` in blocks sorted by ``x``: number, bounds of both columns, and the rows."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = [df.columns.index(x), df.columns.index(y)]
    plain = df.toDF(*names)
    placed = plain.withColumn("_place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(names[at[0]], names[at[1]], "_place").sortWithinPartitions(names[at[0]])
    ranged = ranged.drop("_place").withColumn("_part", F.spark_partition_id())
    kinds = [df.schema[c].dataType.simpleString() for c in (x, y)]
    schema = f"block bigint, low_x {kinds[0]}, high_x {kinds[0]}, low_y {kinds[1]}, high_y {kinds[1]}, data binary"

    def run(batches):
        waiting, n, serial = [], 0, 0

        def packed(table):
            nonlocal serial
            part = table.column("_part")[0].as_py()
            table = table.drop_columns(["_part"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            bounds = [pc.min_max(table.column(c)).as_py() for c in at]
            row = [(part << 32) + serial, bounds[0]["min"], bounds[0]["max"], bounds[1]["min"], bounds[1]["max"], sink.getvalue().to_pybytes()]
            serial += 1
            kinds = [pa.int64(), *[table.schema.field(at[0]).type] * 2, *[table.schema.field(at[1]).type] * 2, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["block", "low_x", "high_x", "low_y", "high_y", "data"])

        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                if n and n + part.num_rows > block_rows:
                    yield packed(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
                waiting.append(part)
                n += part.num_rows
        if waiting:
            yield packed(pa.Table.from_batches(waiting))

    return ranged.mapInArrow(run, schema)


def _pairs(left, right, first, second):
    """Numbers of the blocks that can hold matches; each side's bounds are a line a block."""
    able = None
    for axis, (greater, equal) in (("x", first), ("y", second)):
        ranks = {v: i for i, v in enumerate(sorted({r[f"{end}_{axis}"] for r in (*left, *right) for end in ("low", "high")}))}
        of = lambda rows, end: np.array([ranks[r[f"{end}_{axis}"]] for r in rows], np.int64)  # noqa: B023, E731
        mine, other = (of(left, "high"), of(right, "low")) if greater else (of(right, "high"), of(left, "low"))
        both = (np.greater_equal if equal else np.greater).outer(mine, other)
        both = both if greater else both.T
        able = both if able is None else able & both
    i, j = np.nonzero(able)
    return [(left[a].block, right[b].block) for a, b in zip(i.tolist(), j.tolist())]


def _comparable(column):
    values = column.to_numpy()
    return values if values.dtype != object else np.array(values.tolist(), dtype=object)


def _matches(left, right, first, second):
    """Slices of row numbers, left and right, that match."""
    (lx, ly), (rx, ry) = left, right
    by_x = np.argsort(lx, kind="stable")  # places in the array of bits
    place = np.empty(len(lx), np.int64)
    place[by_x] = np.arange(len(lx))
    borders = np.searchsorted(lx[by_x], rx, side=_BORDER[first])  # between left rows that match and that do not
    by_y, others = np.argsort(ly, kind="stable"), np.argsort(ry, kind="stable")
    counts = np.searchsorted(ly[by_y], ry, side=_BORDER[second])
    if second[0]:  # larger left values are wanted: the largest are entered first
        by_y, others, counts = by_y[::-1], others[::-1], len(ly) - counts
    bits, entered = np.zeros(len(lx), bool), 0
    i, j, n = [], [], 0
    for r in others:
        until = counts[r]
        if until > entered:
            bits[place[by_y[entered:until]]] = True
            entered = until
        found = np.flatnonzero(bits[borders[r] :]) + borders[r] if first[0] else np.flatnonzero(bits[: borders[r]])
        for start in range(0, len(found), OUTPUT_ROWS):
            piece = by_x[found[start : start + OUTPUT_ROWS]]
            i.append(piece)
            j.append(np.full(len(piece), r))
            n += len(piece)
            if n >= OUTPUT_ROWS:
                yield np.concatenate(i), np.concatenate(j)
                i, j, n = [], [], 0
    if n:
        yield np.concatenate(i), np.concatenate(j)
