"""Totals over the pairs of a join on two inequalities, without the pairs.

The values of both sides are cut by borders, so that no gap between two borders holds more than a
part of the rows; a value that many rows have is a border of its own. A left row matches the cells
of borders and gaps that lie wholly on the right side of it, which a small grid of running totals
answers, and some rows of its own gap in each column, which are compared within that gap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.errors import SpecError
from tidemill.session import materialize

#: Parts that gaps are no larger than; a column has at most a third more borders, and the grid four times their square cells.
MAX_BORDERS = 256
_KINDS = ("count", "sum", "min", "max")
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def pair_totals(
    left: DataFrame, right: DataFrame, first: tuple, second: tuple, signs: tuple, totals: dict[str, tuple], gap_rows: int
) -> DataFrame:
    """Left rows that match any right row, with ``totals`` over those they match.

    ``totals`` names columns as ``("count", None)``, or ``sum``, ``min`` or ``max`` with a column of
    numbers. ``signs`` says for both inequalities whether larger left values are wanted and whether
    equal ones match. A gap has ``gap_rows`` rows or a 256th of all, whichever is more, and a task
    compares it in time by the square of the logarithm of its rows for each of them.
    """
    spark, plans = left.sparkSession, _plans(right, totals)
    ends = [(first[0], second[0]), (first[2], second[2])]
    kinds = [left.select(a).union(right.select(b)).schema[0].dataType for a, b in zip(*ends)]
    names, carried = left.columns, [f"c{i}" for i in range(len(left.columns))]
    placed = [F.col(c).cast(kind).alias(name) for c, kind, name in zip(ends[0], kinds, ("_x", "_y"))]
    lefts = materialize(left.select("*", *placed).toDF(*carried, "_x", "_y"), "left")
    placed = [F.col(c).cast(kind).alias(name) for c, kind, name in zip(ends[1], kinds, ("_x", "_y"))]
    values = {c: kind for _, c, kind, _ in plans if c}
    rights = materialize(right.select(*placed, *[F.col(c).cast(_sql(k)).alias(f"v_{c}") for c, k in values.items()]), "right")
    step = max(gap_rows, -(-(lefts.count() + rights.count()) // MAX_BORDERS))
    borders = [_borders(lefts.select(c).union(rights.select(c)), step) for c in ("_x", "_y")]
    rights = _binned(rights, borders)
    grids = _grids(rights, borders, plans, signs)
    sums = T.StructType([T.StructField(f"t{i}", _type(p)) for i, p in enumerate(plans)])
    binned = _binned(lefts, borders)
    schema = T.StructType([*binned.schema, *sums])
    arrow, before = to_arrow_schema(schema), len(binned.columns)

    def from_grid(batches):
        for batch in batches:
            at = tuple(_reach(batch.column(b).to_numpy(), len(v), *s) for b, v, s in zip(("_bx", "_by"), borders, signs))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(g[at]) for g in grids)], schema=arrow)

    def from_gap(axis):
        def run(key, mine, others):
            if not mine.num_rows or not others.num_rows:
                return mine
            places = []
            for i, (value, bin_) in enumerate((("_x", "_bx"), ("_y", "_by"))):
                if axis == 1 and i == 0:  # rows of the own gap in x are counted there, so only whole bins are wanted
                    reach = _reach(mine.column(bin_).to_numpy(), len(borders[0]), *signs[0])
                    bins = _turned(others.column(bin_).to_numpy(), len(borders[0]), signs[0][0])
                    places.append(_ranks(bins, reach, True, False))
                else:
                    places.append(_ranks(_comparable(others.column(value)), _comparable(mine.column(value)), *signs[i]))
            found = _below(places[0], places[1], [_start(p, others) for p in plans], plans)
            for i, (plan, extra) in enumerate(zip(plans, found)):
                both = _merge(plan)(mine.column(f"t{i}").to_numpy(), extra)
                mine = mine.set_column(before + i, f"t{i}", pa.array(both))
            return mine.cast(arrow)

        return run

    work = binned.mapInArrow(from_grid, schema)
    for axis, column in enumerate(("_bx", "_by")):
        work, gap = materialize(work, "totals"), F.col(column) % 2 == 0
        near = work.where(gap).groupBy(column).cogroup(rights.where(gap).groupBy(column))
        work = work.where(~gap).union(near.applyInArrow(from_gap(axis), schema))
    return work.where("t0 > 0").select(*[F.col(c).alias(n) for c, n in zip(carried, names)], *_results(plans, totals))


def _plans(right, totals):
    """What is totalled: name, column, kind of number, operation; the count of pairs first."""
    plans = [(None, None, np.int64, "count")]
    for name, (how, column) in totals.items():
        if how not in _KINDS:
            raise SpecError(f"totals are {', '.join(_KINDS)}")
        if how == "count" and column is None:
            continue
        whole = isinstance(right.schema[column].dataType, _WHOLE)
        if not whole and not isinstance(right.schema[column].dataType, (T.FloatType, T.DoubleType)):
            raise SpecError(f"{column} holds no whole or floating numbers")
        kind = np.int64 if whole else np.float64
        plans.append((f"n_{name}", column, kind, "count"))
        if how != "count":
            plans.append((name, column, kind, how))
    return plans


def _results(plans, totals):
    at = {name: F.col(f"t{i}") for i, (name, *_) in enumerate(plans)}
    for name, (how, column) in totals.items():
        some = at[f"n_{name}"] if column else F.col("t0")
        yield (some if how == "count" else F.when(some > 0, at[name])).alias(name)


def _sql(kind):
    return "bigint" if kind is np.int64 else "double"


def _type(plan):
    return T.LongType() if plan[3] == "count" or plan[2] is np.int64 else T.DoubleType()


def _identity(plan):
    _, _, kind, how = plan
    if how in ("count", "sum"):
        return np.int64(0) if how == "count" else kind(0)
    if kind is np.int64:
        return np.iinfo(np.int64).max if how == "min" else np.iinfo(np.int64).min
    return np.float64("nan") if how == "min" else np.float64("-inf")


def _merge(plan):
    """NaN is the greatest number, as in Spark."""
    return {"min": np.fmin, "max": np.maximum}.get(plan[3], np.add)


def _start(plan, rows):
    """What each row adds to a total."""
    _, column, _, how = plan
    if column is None:
        return np.ones(rows.num_rows, np.int64)
    values = rows.column(f"v_{column}")
    there = values.is_valid().to_numpy()
    if how == "count":
        return there.astype(np.int64)
    identity = _identity(plan)
    return np.where(there, values.fill_null(pa.scalar(identity, values.type)).to_numpy(), identity)


def _comparable(column):
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values if values.dtype != object else np.array(values.tolist(), dtype=object)


def _borders(values, step):
    """Sorted values between which there are fewer than ``step`` rows; a value with more is one of them."""
    counted = values.toDF("v").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    share = max(1, step // 4)
    kind = counted.schema["v"].dataType
    schema = T.StructType([T.StructField("v", kind), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen = told = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            upto = seen + np.cumsum(batch.column("n").to_numpy())
            passed = upto // share
            at = np.flatnonzero(passed > np.concatenate([[told // share], passed[:-1]]))
            counts = np.diff(np.concatenate([[told], upto[at]]))
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(at)), pa.array(counts)], schema=arrow)
                told = int(upto[at[-1]])
            seen, last = int(upto[-1]), batch.column("v").slice(batch.num_rows - 1)
        if seen > told:
            yield pa.RecordBatch.from_arrays([last, pa.array([seen - told])], schema=arrow)

    lines = counted.repartitionByRange("v").sortWithinPartitions("v").mapInArrow(run, schema).toArrow()
    if not lines.num_rows:
        return np.empty(0, np.int64)
    found, counts = _comparable(lines.column("v")), lines.column("n").to_numpy()
    order, kept, since = np.argsort(found, kind="stable"), [], 0
    for i in order:
        since += counts[i]
        if since >= step - share:
            kept.append(i)
            since = 0
    return found[kept]


def _binned(df, borders):
    """``df`` with the numbers of the bins of ``_x`` and ``_y``: odd for a border, even for a gap."""
    schema = T.StructType([*df.schema, T.StructField("_bx", T.LongType()), T.StructField("_by", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            bins = [_bin(_comparable(batch.column(c)), b) for c, b in zip(("_x", "_y"), borders)] if batch.num_rows else [[], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(b, pa.int64()) for b in bins)], schema=arrow)

    return df.mapInArrow(run, schema)


def _bin(values, borders):
    if not len(borders):
        return np.zeros(len(values), np.int64)
    at = np.searchsorted(borders, values)
    return 2 * at + (borders[np.minimum(at, len(borders) - 1)] == values).astype(np.int64)


def _turned(bins, borders, greater):
    """Bins counted from where right values match first."""
    return bins if greater else 2 * borders - bins


def _reach(bins, borders, greater, equal):
    """How many bins, counted so, match wholly."""
    return _turned(bins, borders, greater) + ((bins % 2 == 1) if equal else 0)


def _grids(rights, borders, plans, signs):
    """Totals of all right rows in the first so many bins of both columns."""
    sums = [F.count(F.lit(1)).alias("t0")]
    for i, (_, column, _, how) in enumerate(plans[1:], 1):
        sums.append(getattr(F, how)(f"v_{column}").alias(f"t{i}"))
    cells = rights.groupBy("_bx", "_by").agg(*sums).toArrow()
    at = tuple(_turned(cells.column(c).to_numpy(), len(b), s[0]) + 1 for c, b, s in zip(("_bx", "_by"), borders, signs))
    grids = []
    for i, plan in enumerate(plans):
        grid = np.full([2 * len(b) + 2 for b in borders], _identity(plan))
        values = cells.column(f"t{i}")
        grid[at] = values.fill_null(pa.scalar(_identity(plan), values.type)).to_numpy()
        grids.append(_merge(plan).accumulate(_merge(plan).accumulate(grid, axis=0), axis=1))
    return grids


def _ranks(right, left, greater, equal):
    """Each right value's place in the order in which they match, and how many of these match each left value."""
    order = np.argsort(right, kind="stable")
    sorted_ = right[order]
    found = np.searchsorted(sorted_, left, side="right" if greater == equal else "left")
    place = np.empty(len(right), np.int64)
    place[order] = np.arange(len(right))
    return (place, found) if greater else (len(right) - 1 - place, len(right) - found)


def _below(first, second, starts, plans):
    """Totals of the rows that lie before a left row in both orders.

    Rows in the first order make blocks of each power of two, sorted by the second one; the rows
    before a left row are one block for each bit of their number.
    """
    (x, until_x), (y, until_y) = first, second
    levels = max(1, len(x) - 1).bit_length()
    size = 1 << levels
    key, by_x = np.arange(len(x), size + len(x), dtype=np.int64), np.argsort(x)
    key[: len(x)] = y[by_x]
    values = []
    for plan, start in zip(plans, starts):
        whole = np.full(size, _identity(plan))
        whole[: len(x)] = start[by_x]
        values.append(whole)
    out = [np.full(len(until_x), _identity(plan)) for plan in plans]
    span = size + len(x)
    for level in range(levels + 1):
        length = 1 << level
        rows = key.reshape(-1, length)
        if level:
            order = np.argsort(rows, axis=1, kind="stable")
            key = np.take_along_axis(rows, order, axis=1).ravel()
            values = [np.take_along_axis(v.reshape(-1, length), order, axis=1).ravel() for v in values]
        asked = np.flatnonzero(until_x & length)
        if not len(asked):
            continue
        block = (until_x[asked] >> (level + 1)) << 1
        flat = key + np.repeat(np.arange(size // length) * span, length)
        to = np.searchsorted(flat, block * span + until_y[asked])
        some = to > block * length
        for i, plan in enumerate(plans):
            running = _merge(plan).accumulate(values[i].reshape(-1, length), axis=1).ravel()
            out[i][asked[some]] = _merge(plan)(out[i][asked[some]], running[to[some] - 1])
    return out
