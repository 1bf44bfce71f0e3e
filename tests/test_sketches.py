import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.errors import SpecError
from tidemill.functions.semistructured import found_type, typed_columns
from tidemill.operators.sketches import exact_distinct, merge, sketch, store


def test_days_are_stored_by_and_by_and_merged(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "state")
    rows = [(day, "hot" if rng.random() < 0.8 else "cold", rng.randint(1, 9000), rng.random()) for day in (1, 2, 3) for _ in range(8000)]
    days = spark.createDataFrame([*rows, (1, "none", None, None)], "day int, kind string, who bigint, value double").cache()
    put = lambda of: store(sketch(of, F.col("day"), ["kind"], "who", "value"), path)
    put(days.where("day = 1"))
    put(days.where("day = 2").limit(100))  # a first, short delivery of the day
    put(days.where("day >= 2"))
    for where, wanted in (("true", (1, 2, 3)), ("period >= 2", (2, 3))):
        people, values = defaultdict(set), defaultdict(list)
        for day, kind, who, value in rows:
            if day in wanted:
                people[kind].add(who)
                values[kind].append(value)
        got = {r.kind: r for r in merge(spark, path, ["kind"], [0.1, 0.5, 0.99], where).collect()}
        for kind in people:
            assert got[kind].n == len(values[kind]) and abs(got[kind].distinct / len(people[kind]) - 1) < 0.05
            for q, about in zip((0.1, 0.5, 0.99), got[kind].quantiles):
                assert abs(sum(v <= about for v in values[kind]) / len(values[kind]) - q) < 0.02
    assert (merge(spark, path, ["kind"], [0.5]).where("kind = 'none'").first()[1:]) == (1, 0, None)
    exact = {r.kind: r.exact for r in exact_distinct(days, ["kind"], "who").collect()}
    assert exact == {kind: len({r[2] for r in rows if r[1] == kind}) for kind in ("hot", "cold")}


def test_typed_columns_of_undeclared_json(spark):
    texts = ['{"a": 1, "b": {"c": "x"}}', '{"a": 2.5, "VOID": null, "OBJECT": [1, 2]}', "not json", None, '{"mixed": 1}', '{"mixed": "one"}', "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, props string")
    got = typed_columns(rows, "props")
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields[2:]}
    assert kinds.pop("props_a").startswith("decimal")
    assert kinds == {"props_b": "struct<c:string>", "props_VOID": "string", "props_OBJECT": "array<bigint>", "props_mixed": "variant"}
    found = {r.id: r for r in got.drop("props_mixed").collect()}
    assert float(found[0].props_a) == 1 and found[0].props_b.c == "x" and float(found[1].props_a) == 2.5 and found[1].props_OBJECT == [1, 2]
    assert all(found[i].props_a is None for i in (2, 3, 4, 6))
    assert typed_columns(rows.limit(0), "props").columns == ["id", "props"]
    with pytest.raises(SpecError):
        typed_columns(rows.withColumn("PROPS_A", F.lit(1)), "props")
    with pytest.raises(SpecError):
        found_type(rows, "props") and typed_columns(rows.select(F.lit("[1]").alias("props")), "props")
