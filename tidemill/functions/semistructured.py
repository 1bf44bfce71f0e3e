"""Typed columns out of JSON text whose shape nobody declared."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.errors import SpecError

# Names are left as they are, whatever they say: quoted, or plain before a colon.
_TYPES = re.compile(r"`(?:[^`]|``)*`|\bOBJECT<|\bVOID\b(?!:)")


def found_type(rows: DataFrame, json_col: str) -> str:
    """The type that all JSON texts of a column fit, as SQL; one pass, partly aggregated in the tasks.

    Fields are those of any row. A field of numbers takes the widest kind of number, one of
    differing kinds is ``VARIANT``, one that is always null ``STRING``. Texts that are not JSON do not count.
    """
    found = rows.agg(F.schema_of_variant_agg(F.try_parse_json(json_col))).first()[0]
    own = {"OBJECT<": "STRUCT<", "VOID": "STRING"}
    return _TYPES.sub(lambda m: own.get(m.group(), m.group()), found)


def typed_columns(rows: DataFrame, json_col: str, prefix: str | None = None) -> DataFrame:
    """The rows with a column ``prefix`` + name for each field of the JSON objects in ``json_col``.

    ``prefix`` is the column's name and an underscore unless given. Fields of inner objects stay
    structs. Rows without the field, null texts and texts that are not JSON have nulls, other
    values than objects too. With no object at all nothing is added; names that the rows already
    have are an error.
    """
    kind = found_type(rows, json_col)
    if not kind.startswith("STRUCT<"):
        if kind in ("STRING", "STRUCT<>"):
            return rows
        raise SpecError(f"values of {json_col!r} are not all objects, but {kind}")
    prefix = f"{json_col}_" if prefix is None else prefix
    value = F.try_variant_get(F.try_parse_json(json_col), "$", kind)
    fields = rows.select(value.alias("v")).schema["v"].dataType.fieldNames()
    names = [f"{prefix}{field}" for field in fields]
    taken = {c.lower() for c in rows.columns} & {n.lower() for n in names}
    if taken:
        raise SpecError(f"columns {sorted(taken)} exist already; give a prefix")
    return rows.withColumns({name: value.getField(field) for name, field in zip(names, fields)})
