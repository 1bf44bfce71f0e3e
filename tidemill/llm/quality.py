"""Quality rules on documents, and verdicts on the hosts they come from."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import by_slices, kept, map_rows, measured_broadcast
from tidemill.llm.word_hashes import spaced

_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
_SYMBOLS = re.compile(r"[#*$%&|<>]").findall

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules a document can fail, as SQL over the measures. The first two reject it by themselves.
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
RULES = (
    "n_words < 50",
    "100 * n_repeat_words > 50 * n_words",
    "n_symbols * 10 > n_words",
    "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "n_dup_lines >= 10",
)
FAILED = " OR ".join(f"({rule})" for rule in RULES)
#: A host is rejected if more than this share of its documents, after shrinking, fail any rule.
MAX_RATE = 0.5
#: Characters that the rule on word lengths takes a letter of a script without spaces for.
LETTER_CHARS = 4


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The measures of a text; null has none of anything.

    Positions of words are marked when a window of three words over them occurs at least
    twice, also if it overlaps itself; ``n_repeat_words`` counts marked positions once each.
    """
    text = text or ""
    words = _WORDS(text)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    first, marked = {}, set()
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        before = first.setdefault(window, i)
        if before != i:
            marked.update((before, before + 1, before + 2, i, i + 1, i + 2))
    return len(words), sum(map(len, words)), len(_SYMBOLS(text)), len(lines) - len(set(lines)), len(marked)


def measure_any(text: str | None) -> tuple[int, int, int, int, int]:
    """The same, but each letter of a script without spaces is a word, which counts as one of usual length."""
    apart = spaced(text or "")
    n_words, chars, *others = measure(apart)
    letters = (len(apart) - len(text or "")) // 2
    return n_words, chars + letters * (LETTER_CHARS - 1), *others


def with_measures(docs: DataFrame, carry: list[str], text_col: str = "text", measure=measure) -> DataFrame:
    """``carry`` and the measures of each document, by ``measure``; a map."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def make():
        def run(*columns):
            measures = [measure(t) for t in columns[-1]]
            return [*columns[:-1], *([m[i] for m in measures] for i in range(len(MEASURES)))]

        return run

    schema = f"{kinds}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return map_rows(docs, [*(F.col(c) for c in carry), F.col(text_col)], schema, make)


def host_verdicts(measured: DataFrame, host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """``(host, n_docs, failures, rate, rejected)`` for each host; null hosts have none.

    A document is one trial of its host, failed if it breaks any rule. The prior is a beta
    distribution with the mean of the hosts' raw rates and their variance without what chance adds
    to hosts of few documents (moments over hosts with at least one document, from one row of
    sums), so a host with few documents stays near the common rate. Without
    variance between hosts there is nothing to learn from, and the prior weighs as much as
    the documents of all hosts together.
    """
    hosts = (
        measured.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.expr(f"int({FAILED})")).alias("failures"))
    )
    raw, chance = F.col("failures") / F.col("n_docs"), F.avg(1 / F.col("n_docs"))
    sums = hosts.agg(F.sum("n_docs").alias("n"), F.var_pop(raw).alias("v"), F.avg(raw).alias("m"), chance.alias("a"))
    sums = sums.withColumn("most", F.col("m") * (1 - F.col("m"))).withColumn("between", F.col("v") - F.col("a") * F.col("most"))
    sums = sums.select(
        F.col("m"),
        F.when(F.col("between") > 0, F.greatest((1 - F.col("a")) * F.col("most") / F.col("between") - 1, F.lit(0.0)))
        .otherwise(F.col("n").cast("double"))
        .alias("strength"),
    )
    rate = (F.col("failures") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return (
        hosts.join(F.broadcast(sums))  # one row
        .select("host", "n_docs", "failures", rate.alias("rate"))
        .withColumn("rejected", F.col("rate") > max_rate)
    )


def _rejected(measured, host_col, max_rate):
    """Hosts to reject, marked for broadcast only after their measured size allowed it."""
    hosts, _ = kept(host_verdicts(measured, host_col, max_rate).where("rejected").select("host"), "hosts")
    return measured_broadcast(hosts, F.octet_length("host") + 64)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = MAX_RATE,
) -> DataFrame:
    """One row per document: id, the measures, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and its host is not rejected. Failures are
    counted by host before anything is joined; a host with very many documents is one row by
    then, and where rejected hosts are too many to broadcast the adaptive skew join splits it.
    Null texts have no words and fail; documents without a host have only the base rules to
    pass. Repeated rows count as often as they occur; other columns are not read.
    """
    carry = docs.select(F.col(id_col), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    measured, _ = kept(with_measures(carry, [id_col, "_host"], "_text"), "measured")
    bad = _rejected(measured, "_host", max_rate).withColumn("host_failed", F.lit(True))
    failed = F.expr(BASE_FAILED)
    return measured.join(bad, F.col("_host") == F.col("host"), "left").select(
        id_col, *MEASURES, failed.alias("base_failed"), (~failed & F.col("host_failed").isNull()).alias("kept")
    )


def keep_good(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE
) -> DataFrame:
    """The documents that pass the base rules and whose host is not rejected, with all their columns.

    As ``quality_rules``, but of scripts written without spaces each letter counts as a word, so
    that such texts are not too short. Null and empty texts go; documents without a host have only
    the base rules to pass; repeated rows are judged alike; no text is cut; an empty table stays
    empty. Texts are not shuffled unless rejected hosts are too many to broadcast.
    """
    columns = docs.columns
    host, text = F.col(host_col), F.col(text_col)
    measured, drop = kept(with_measures(docs.select(host.alias("_host"), text.alias("_text")), ["_host"], "_text", measure_any), "measured")
    bad = _rejected(measured, "_host", max_rate)
    drop()
    good = _passing(docs, text_col)
    return good.join(bad, good[host_col] == bad["host"], "left_anti").select(*[good[c] for c in columns])


def _passing(docs, text_col):
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in by_slices(batches):
            passed = []
            for text in batch.column(at).to_pylist():
                n, _, _, _, repeated = measure_any(text)
                passed.append(not (n < 50 or 100 * repeated > 50 * n))
            yield batch.filter(pa.array(passed, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
