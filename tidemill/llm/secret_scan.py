"""Secrets in texts, found once for each different text and version of the rules.

A text is a blob named by the SHA-256 of its bytes. A ledger in a folder of its own records
which blobs were scanned under which version of the rules, and what was found. A scan takes
all paths and historical versions there are, scans the blobs whose pair with the version of
the rules is not in the ledger, appends, and joins the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import kept, map_rows, measured_broadcast, text_of
from tidemill.session import scratch_path

#: Kinds in the order in which spans that start together are listed; pattern, group, least length of the group.
BASE_RULES = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
EXTRA_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("bearer", r"(?ai:bearer)\x20+([A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 24),
)
RULES = BASE_RULES + EXTRA_RULES
_FINDINGS = "blob string, rule_version string, kind string, start bigint, end bigint"
_SCANNED = "blob string, rule_version string"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then by the order of the rules; code points, end exclusive.

    Matches of a rule are leftmost and do not overlap; those too short are dropped afterwards.
    """
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        for match in re.finditer(pattern, text):
            if len(match[group]) >= least:
                found.append((match.start(), order, kind, match.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def blobs(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``(path, blob, text)``: the content address of each row; null text is the empty one."""
    text = text_of(text_col)
    return docs.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def update_ledger(spark: SparkSession, ledger: str, versions: DataFrame, rules=RULES) -> None:
    """Scan the blobs of ``versions(path, blob, text)`` that the ledger lacks for these rules.

    Equal texts are brought together by their blob, one text each, after each task has already
    kept one of its own copies, so a group of copies of any size is a few rows. A run that
    fails before the list of scanned blobs is written is repeated; findings are distinct when
    read, so what it left does no harm.
    """
    version = rule_version(rules)
    known = _read(spark, ledger, "scanned", _SCANNED)
    unseen = versions.groupBy("blob").agg(F.first("text").alias("text"))
    if known is not None:
        unseen = unseen.join(known.where(F.col("rule_version") == version), "blob", "left_anti")

    def make():
        def scan(names, texts):
            out = []
            for name, text in zip(names, texts):
                spans = find(text, rules)
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            return names, out

        return scan

    schema = "blob string, spans array<struct<kind: string, start: bigint, end: bigint>>"
    scanned, drop = kept(map_rows(unseen, ["blob", "text"], schema, make), "scan")
    stamp = F.lit(version).alias("rule_version")
    scanned.select("blob", stamp, F.inline("spans")).write.mode("append").parquet(f"{ledger}/findings")
    scanned.select("blob", stamp).write.mode("append").parquet(f"{ledger}/scanned")
    drop()


def findings(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """``(blob, spans)`` of the blobs in which these rules found something, spans in order."""
    found = _read(spark, ledger, "findings", _FINDINGS)
    if found is None:
        found = spark.createDataFrame([], _FINDINGS)
    order = F.create_map(*[F.lit(x) for i, rule in enumerate(rules) for x in (rule[0], i)])
    span = F.struct("start", order[F.col("kind")].alias("order"), "kind", "end")
    return (
        found.where(F.col("rule_version") == rule_version(rules))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_set(span)).alias("spans"))
    )


def _read(spark, ledger, name, schema):
    try:
        return spark.read.schema(schema).parquet(f"{ledger}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules=RULES
) -> DataFrame:
    """One row per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    ``ledger`` is a folder all executors reach; without one the scan starts from nothing.
    Every row is a path, null ids and repeated rows included; null text is the empty blob,
    which has no findings. No text is cut. Other columns are not read. Spans of a very long
    text are one list in one row, as its text is.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    versions = blobs(docs, id_col, text_col)
    update_ledger(spark, ledger, versions, rules)
    found, _ = kept(findings(spark, ledger, rules), "findings")
    spans = F.coalesce(F.col("spans"), F.array())
    base = F.filter(spans, lambda s: s["kind"].isin([r[0] for r in BASE_RULES]))
    number = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return (
        versions.select("path", "blob")
        .join(_small(found), "blob", "left")
        .select(
            F.col("path").alias(id_col),
            *[number(rule[0]) for rule in BASE_RULES],
            F.sha2(_joined(base), 256).alias("base_sha256"),
            _joined(spans).alias("spans"),
        )
    )


def redact_secrets(
    docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", ledger: str | None = None, rules=RULES
) -> DataFrame:
    """All documents with their columns, each secret in the text replaced by ``[kind]``.

    Overlapping spans are replaced together, under the kind of the first. ``chars_col``, if the
    documents have it, follows the new text. Findings meet the documents by blob: by broadcast
    where they were measured to be few, otherwise by a shuffle.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    update_ledger(spark, ledger, blobs(docs.withColumn("_none", F.lit(None)), "_none", text_col), rules)
    found, _ = kept(findings(spark, ledger, rules).withColumnsRenamed({"blob": "_blob", "spans": "_spans"}), "findings")
    columns = docs.columns
    joined = docs.withColumn("_blob", F.sha2(text_of(text_col), 256)).join(_small(found, "_blob", "_spans"), "_blob", "left")
    # Spans are cut out from the end; each piece of text between them is copied once.
    place = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.col(text_col)

    def step(done, span):
        fresh = span["start"] >= done["at"]
        piece = F.concat(F.substr(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.lit("["), span["kind"], F.lit("]"))
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(done["parts"], F.array(piece))).otherwise(done["parts"]).alias("parts"),
        )

    done = F.aggregate("_spans", place, step)
    redacted = F.concat(F.array_join(done["parts"], ""), F.substr(text, (done["at"] + 1).cast("int")))
    new = F.when(F.col("_spans").isNull(), text).otherwise(redacted)
    out = joined.withColumn("_new", new)
    changed = {text_col: F.col("_new")}
    if chars_col in columns:
        changed[chars_col] = F.when(F.col("_spans").isNull(), F.col(chars_col)).otherwise(F.char_length("_new").cast(docs.schema[chars_col].dataType))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in columns])


def _small(found, blob="blob", spans="spans"):
    return measured_broadcast(found, F.octet_length(blob) + F.size(spans) * 48 + 64)
