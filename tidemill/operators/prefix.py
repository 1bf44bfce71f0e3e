"""Windows in one global order, or over keys of any size, without a task that sees them all.

Rows are range-partitioned by key and order, so parts follow one another. Each part computes its
own windows; what the parts before it add up to is carried over: one row a part, summed on the
driver. Values that look back or ahead across a border come from halo rows, copies of the few rows
next to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemill.errors import SpecError
from tidemill.session import materialize

#: Running functions: how parts are summed up, and how a carried value joins the part's own.
_RUNNING = {
    "count": (F.count, lambda carried, own: carried + own),
    "sum": (F.sum, lambda carried, own: F.coalesce(carried + own, carried, own)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}
_RANKS = ("row_number", "rank", "dense_rank")
_NEAR = ("lag", "lead", "sum", "count", "min", "max")


@dataclass(frozen=True)
class Running:
    """``function`` (count, sum, min, max) of a column over all rows up to this one."""

    function: str
    column: str


@dataclass(frozen=True)
class Rank:
    """``row_number``, ``rank`` or ``dense_rank`` of a row."""

    function: str


@dataclass(frozen=True)
class Near:
    """``lag`` or ``lead`` by ``rows`` rows, or count, sum, min or max over the last ``rows`` rows and this one."""

    function: str
    column: str
    rows: int = 1


def prefix_windows(df: DataFrame, order: list[str], columns: dict, keys: list[str] = (), unique: list[str] = ()) -> DataFrame:
    """``df`` with a new column for each entry of ``columns``, over rows ordered by ``order`` within ``keys``.

    Orders ascend, nulls first; null keys are one key. Rows that tie are ordered by ``unique`` and
    then as they were read, and may lie in several parts; ``rank`` and ``dense_rank`` regard
    ``order`` alone. One key may hold all rows. The rows are shuffled twice, by ranges and by part;
    other tables hold one row a part, or the ``rows`` next to each border. Sums of whole numbers and
    decimals are exact; of floating-point numbers they depend on where parts end, in their last digits.
    """
    for spec in columns.values():
        allowed = _RUNNING if isinstance(spec, Running) else _RANKS if isinstance(spec, Rank) else _NEAR
        if spec.function not in allowed:
            raise SpecError(f"{type(spec).__name__} cannot be {spec.function!r}")
    taken = {c.lower() for c in df.columns}
    fresh = lambda name: next(n for n in (f"{name}{'_' * i}" for i in range(1, 99)) if n.lower() not in taken)
    part, place, halo = fresh("part"), fresh("place"), fresh("halo")
    keys, order = list(keys), list(order)
    by = [*keys, *order, *unique, place]
    rows = df.withColumn(place, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).withColumn(part, F.spark_partition_id())
    rows = materialize(rows, "ranged")
    key, value = _struct(keys), _struct([*keys, *order])
    ends = rows.groupBy(part).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")
    )
    ends = sorted(ends.collect(), key=lambda r: r[part])
    carried = _carried(rows, ends, part, key, value, list(columns.values()))
    reach = max([spec.rows for spec in columns.values() if isinstance(spec, Near)], default=0)
    before = any(isinstance(s, Near) and s.function != "lead" for s in columns.values()) * reach
    after = any(isinstance(s, Near) and s.function == "lead" for s in columns.values()) * reach
    whole = rows.withColumn(halo, F.lit(False))
    for n, side in ((before, -1), (after, 1)):
        if n:
            whole = whole.unionByName(_halo(rows, ends, part, by, n, side).withColumn(halo, F.lit(True)))
    ordered = Window.partitionBy(part, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in by])
    so_far, own = ordered.rowsBetween(Window.unboundedPreceding, 0), ~F.col(halo)
    values = Window.partitionBy(part, *keys).orderBy(halo, *[F.col(c).asc_nulls_first() for c in order])
    local = {}
    for i, spec in enumerate(columns.values()):
        if isinstance(spec, Running):
            local[f"own{i}"] = _RUNNING[spec.function][0](F.when(own, F.col(spec.column))).over(so_far)
        elif isinstance(spec, Rank) and spec.function == "row_number":
            local[f"own{i}"] = F.count(F.when(own, 1)).over(so_far)
        elif isinstance(spec, Rank):
            local[f"own{i}"] = getattr(F, spec.function)().over(values).cast("bigint")
        elif spec.function in ("lag", "lead"):
            local[f"own{i}"] = getattr(F, spec.function)(spec.column, spec.rows).over(ordered)
        else:
            local[f"own{i}"] = getattr(F, spec.function)(spec.column).over(ordered.rowsBetween(-spec.rows, 0))
    named = {c: fresh(c) for c in local}
    computed = whole.withColumns({named[c]: v for c, v in local.items()}).where(own)
    computed = computed.join(F.broadcast(carried), (F.col(part) == F.col("_carry_part")) & key.eqNullSafe(F.col("_carry_key")), "left")
    out = [F.col(f"`{c}`") for c in df.columns]
    for i, (name, spec) in enumerate(columns.items()):
        mine = F.col(named[f"own{i}"])
        more = None if isinstance(spec, Near) else F.col(f"_carry_c{i}")
        if isinstance(spec, Running):
            result = F.when(F.col("_carry_part").isNull(), mine).otherwise(_RUNNING[spec.function][1](more, mine))
        elif isinstance(spec, Rank):
            result = mine + F.coalesce(more, F.lit(0))
            if spec.function == "rank":  # a tie that began in an earlier part has the rank it has there
                result = F.when(value.eqNullSafe(F.col("_carry_value")), F.col(f"_carry_t{i}")).otherwise(result)
        else:
            result = mine
        out.append(result.alias(name))
    return computed.select(*out)


def _struct(names):
    """The columns as one value to compare by; a constant without any."""
    return F.struct(*[F.col(n) for n in names]) if names else F.struct(F.lit(0).alias("all"))


def _carried(rows, ends, part, key, value, specs):
    """For each part whose first key began earlier: that key, the last value before the part, and by
    column what is to be added there (``c``) and the rank of a tie with that value (``t``)."""
    spark = rows.sparkSession
    typed = rows.select(F.lit(0).alias("part"), key.alias("key"), value.alias("value")).schema
    last = spark.createDataFrame([(e[part], e.last_key, e.last) for e in ends], typed)
    sums = []
    for i, spec in enumerate(specs):
        if isinstance(spec, Running):
            sums.append(_RUNNING[spec.function][0](spec.column).alias(f"c{i}"))
        elif isinstance(spec, Rank):
            sums.append((F.count_distinct(value) if spec.function == "dense_rank" else F.count(F.lit(1))).alias(f"c{i}"))
    last = last.select(*[F.col(c).alias(f"_last_{c}") for c in last.columns])
    here = rows.join(F.broadcast(last), (F.col(part) == F.col("_last_part")) & key.eqNullSafe(F.col("_last_key")))
    ties = F.count(F.when(value.eqNullSafe(F.col("_last_value")), 1)).alias("ties")
    totals = here.groupBy(F.col("_last_part").alias("part")).agg(ties, F.count(F.lit(1)).alias("n"), *sums)
    fields = [f for f in totals.schema if f.name.startswith("c")]
    found = {r.part: r for r in totals.collect()}
    schema = StructType([*typed, *fields, *[StructField(f"t{f.name[1:]}", LongType()) for f in fields]])
    out, carry, last_value = [], None, None  # of the key that goes on: sums by column, rows, rank of the last value
    for before, after in zip(ends, ends[1:]):
        total = found[before[part]]
        onward = carry is not None and before.first_key == before.last_key
        sums, n, tied = carry if onward else ({}, 0, None)
        sums = {f.name: _joined(specs[int(f.name[1:])].function, sums.get(f.name), total[f.name]) for f in fields}
        rank = tied if onward and before.first == before.last == last_value else n + total.n - total.ties + 1
        n += total.n
        if before.last_key != after.first_key:
            carry = None
            continue
        for f in fields:
            if specs[int(f.name[1:])].function == "dense_rank" and before.last == after.first:
                sums[f.name] -= 1  # counted again where the tie goes on
        carry, last_value = (sums, n, rank), before.last
        out.append((after[part], before.last_key, before.last, *[sums[f.name] for f in fields], *[rank] * len(fields)))
    carried = spark.createDataFrame(out, schema)
    return carried.select(*[F.col(c).alias(f"_carry_{c}") for c in carried.columns])


def _joined(function, a, b):
    if a is None or b is None:
        return b if a is None else a
    return {"min": min, "max": max}.get(function, lambda x, y: x + y)(a, b)


def _halo(rows, ends, part, by, n, side):
    """Copies of the ``n`` rows before (``side`` -1) or after each part, as rows of that part."""
    parts, counts = [e[part] for e in ends], [e.n for e in ends]
    wanted = []
    for at in range(len(parts)):
        far, left = at + side, n
        while 0 <= far < len(parts) and left > 0:
            wanted.append((parts[far], parts[at], left))
            left -= counts[far]
            far += side
    edge = Window.partitionBy(part).orderBy(*[(F.col(c).desc_nulls_last() if side < 0 else F.col(c).asc_nulls_first()) for c in by])
    near = rows.withColumn("edge_rank", F.row_number().over(edge)).where(F.col("edge_rank") <= n)
    targets = rows.sparkSession.createDataFrame(wanted, "from_part int, to_part int, up_to int")
    joined = near.join(F.broadcast(targets), (F.col(part) == F.col("from_part")) & (F.col("edge_rank") <= F.col("up_to")))
    return joined.select(*[F.col("to_part").alias(part) if c == part else F.col(f"`{c}`") for c in rows.columns])
