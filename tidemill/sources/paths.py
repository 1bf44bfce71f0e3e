"""Path patterns: date tokens, base folders, and listings that match across folders."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The date tokens a path pattern may hold.
DATE_TOKENS = ("{YYYY}", "{MM}", "{DD}", "{HH}", "{mm}")
_NOTHING_THERE = ("PATH_NOT_FOUND",)
_WILDCARDS = re.compile(r"([\\*?\[\]{}])")


def expand_date_tokens(pattern: str) -> str:
    """Every date token matches anything; neighbouring wildcards become one."""
    for token in DATE_TOKENS:
        pattern = pattern.replace(token, "*")
    return re.sub(r"\*{2,}", "*", pattern)


def under(base: str, pattern: str) -> str:
    """``pattern`` below ``base``; an absolute path or a URI stands for itself."""
    if pattern.startswith("/") or "://" in pattern:
        return pattern
    return f"{base.rstrip('/')}/{pattern}"


def nothing_there(error: AnalysisException) -> bool:
    """Whether a reader failed because no file matched."""
    return error.getCondition() in _NOTHING_THERE


def literal(path: str) -> str:
    """A name as a pattern that matches just this name."""
    return _WILDCARDS.sub(r"\\\1", path)


def literal_prefix(pattern: str) -> str:
    """The leading folders of a pattern that hold no wildcard."""
    folders = pattern.split("/")[:-1]
    plain = []
    for folder in folders:
        if "*" in folder or "?" in folder:
            break
        plain.append(folder)
    return "/".join(plain)


def key_regex(pattern: str) -> str:
    """A pattern as a regular expression in which wildcards also match ``/``."""
    parts = {"*": ".*", "?": "."}
    return "^" + "".join(parts.get(ch) or re.escape(ch) for ch in pattern) + "$"


def matching_objects(spark: SparkSession, root: str, pattern: str, options: dict[str, str]) -> DataFrame:
    """Full paths below ``root`` whose key matches ``pattern``, wildcards crossing folders.

    Only file metadata is read, and listing starts at the pattern's literal prefix.
    """
    prefix = literal_prefix(pattern)
    start = f"{root}/{prefix}" if prefix else root
    listing = (
        spark.read.format("binaryFile").options(**options).option("recursiveFileLookup", "true").load(start)
    )
    key = F.expr(f"substring(path, instr(path, {_quoted(_after_scheme(root))}) + {len(_after_scheme(root)) + 1})")
    return listing.select("path", key.alias("key")).where(F.col("key").rlike(key_regex(pattern))).select("path")


def _after_scheme(root: str) -> str:
    return root.split("://", 1)[-1].rstrip("/")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
