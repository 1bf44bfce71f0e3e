"""CSV, JSON and Parquet files as DataFrames."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import MissingSource, SpecError
from tidemill.sources.json_layout import split_by_layout
from tidemill.sources.paths import literal, nothing_there
from tidemill.specs import FileSource, struct_of

# Compression names and the file name suffixes Spark decodes them by.
_SUFFIXES = {"gzip": (".gz",), "gz": (".gz",), "bzip2": (".bz2",), "zstd": (".zst",), "snappy": (".snappy",), "lz4": (".lz4",)}
# Delimiters to choose from.
DELIMITERS = (",", "|", ";", "\t")
FORMATS = ("csv", "parquet", "json")
# Fixed value: a zone at the end of a time of day.
_ZONE = r":[0-9]{2}(\.[0-9]+)?\s*(?i:z|utc|gmt|[+-][0-9]{1,2}(:?[0-9]{2})?)$"


def read_files(
    spark: SparkSession,
    paths: str | list[str],
    source: FileSource,
    columns=(),
    options: dict[str, str] | None = None,
) -> DataFrame | None:
    """Files at ``paths`` as one DataFrame; ``None`` when a single pattern matches nothing.

    One text is a pattern. A list holds names: wildcards in them stand for themselves, and each
    must be there, so a lost file is an error and not an empty result. Declared columns spare
    the inference pass over the data.
    """
    if source.format not in FORMATS:
        raise SpecError(f"unsupported format {source.format!r}")
    _check_compression(source, paths)
    options = dict(options or {})
    listed = not isinstance(paths, str)
    paths = [literal(p) for p in paths] if listed else paths
    try:
        if source.format == "parquet":
            return _read_parquet(spark, paths, columns, options)
        if source.format == "csv":
            return _read_csv(spark, paths, source, columns, options)
        return _read_json(spark, paths, source, columns, options)
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        if listed:
            raise MissingSource(f"a listed file is gone: {error}") from error
        return None


def _read_parquet(spark, paths, columns, options):
    df = spark.read.options(**options).parquet(*_listed(paths))
    if not columns:
        return df
    return df.select(*[_named(f).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in struct_of(columns)])


def _named(field):
    return F.col(f"`{field.name}`")


def reader_options(spark: SparkSession, paths, source: FileSource, options: dict[str, str] | None = None) -> dict[str, str]:
    """What batch and streaming readers of text formats are told alike: bad rows end the job."""
    found = {"mode": "FAILFAST"}
    if source.format == "csv":
        found |= csv_options(source) | {"enforceSchema": "false"}
        if source.delimiter == "auto":
            found["sep"] = delimiter_of(spark, paths, options)
    if source.format == "json":
        found["multiLine"] = str(source.layout == "array").lower()
    return found


def _read_csv(spark, paths, source, columns, options):
    header = source.has_header is not False
    reader = spark.read.options(**options).options(**reader_options(spark, paths, source, options))
    if columns:
        schema = struct_of(columns)
        return timestamps_restored(reader.schema(timestamps_as_text(schema)).csv(paths), schema)
    df = reader.option("inferSchema", "true").csv(paths)
    if not header:
        width = len(str(len(df.columns) - 1))
        df = df.toDF(*[f"column{i:0{width}d}" for i in range(len(df.columns))])
    return _wall_clock(df)


def csv_options(source: FileSource) -> dict[str, str]:
    """Reader options a declaration asks for; a quote inside quotes is doubled."""
    options = {
        "header": str(source.has_header is not False).lower(),
        "quote": '"',
        "escape": '"',
        "multiLine": str(source.multi_line).lower(),
    }
    if source.delimiter not in (None, "auto"):
        options["sep"] = source.delimiter
    if source.null_value is not None:
        options["nullValue"] = source.null_value
    return options


def delimiter_of(spark: SparkSession, paths, options: dict[str, str] | None = None) -> str:
    """The only delimiter that occurs equally often, outside of quotes, in every line there is.

    All lines are counted in one pass, without those of white space only. Where none occurs the
    files have one column; where none or several fit, the declaration must name one.
    """
    lines = spark.read.options(**(options or {})).text(paths).where("trim(value) <> ''")
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = [F.length(F.regexp_replace(bare, f"[^{re.escape(d)}]", "")) for d in DELIMITERS]
    bounds = lines.agg(*[f(c).alias(f"{name}{i}") for i, c in enumerate(counts) for name, f in (("low", F.min), ("high", F.max))]).first()
    fitting = [d for i, d in enumerate(DELIMITERS) if bounds[f"low{i}"] and bounds[f"low{i}"] == bounds[f"high{i}"]]
    if not any(bounds[f"high{i}"] for i in range(len(DELIMITERS))):
        return DELIMITERS[0]
    if len(fitting) != 1:
        raise SpecError(f"no single delimiter fits all lines ({fitting or 'none'} would); declare it")
    return fitting[0]


def _read_json(spark, paths, source, columns, options):
    layout = source.layout
    if layout not in ("auto", "lines", "array"):
        raise SpecError(f"unknown JSON layout {layout!r}")
    if layout == "auto":
        lines, arrays = split_by_layout(spark, paths, options)
    else:
        lines, arrays = (paths, None) if layout == "lines" else (None, paths)
    schema = struct_of(columns)
    parts = []
    for part, multi_line in ((lines, False), (arrays, True)):
        if part:
            reader = spark.read.options(**options).option("mode", "FAILFAST").option("multiLine", multi_line)
            parts.append(reader.schema(timestamps_as_text(schema)).json(part) if columns else reader.json(part))
    if len(parts) == 2:
        df = parts[0].unionByName(parts[1], allowMissingColumns=True)
    else:
        df = parts[0]
    return timestamps_restored(df, schema) if columns else df


def timestamps_as_text(schema: T.StructType) -> T.StructType:
    """Read wall-clock timestamps as text first: the readers refuse a zone suffix on them."""
    return T.StructType(
        [
            T.StructField(f.name, T.StringType(), True, f.metadata) if isinstance(f.dataType, T.TimestampNTZType) else f
            for f in schema
        ]
    )


def timestamps_restored(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Texts back to wall-clock time; one with a zone becomes its time in UTC."""
    return df.select(
        *[
            _utc_wall_clock(F.col(f.name)).alias(f.name, metadata=f.metadata or None)
            if isinstance(f.dataType, T.TimestampNTZType)
            else F.col(f.name)
            for f in schema
        ]
    )


def _utc_wall_clock(text):
    # From the instant, not from the session's wall clock, which shows some hours twice.
    instant = F.unix_micros(text.cast("timestamp"))
    in_utc = F.timestamp_add("MICROSECOND", instant, F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.when(text.rlike(_ZONE), in_utc).otherwise(text.cast("timestamp_ntz"))


def _wall_clock(df: DataFrame) -> DataFrame:
    """Inferred timestamps carry no zone in the file, so they are kept as wall-clock time."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def _check_compression(source, paths):
    """Spark decodes by suffix, so a declared compression must agree with the file names."""
    if source.compression in (None, "none", "auto"):
        return
    suffixes = _SUFFIXES.get(source.compression.lower())
    if suffixes is None:
        raise SpecError(f"unknown compression {source.compression!r}")
    if source.format == "parquet":
        return
    for path in _listed(paths):
        name = unquote(path).rstrip("/").rsplit("/", 1)[-1]
        if "." in name and not name.endswith((*suffixes, "*")):
            raise SpecError(f"{source.compression} files must end in {suffixes[0]}: {path}")


def _listed(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)
