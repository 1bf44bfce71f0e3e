"""The operators as registered queries over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.bpe import bpe_round_trip
from tidemill.llm.conversation_repair import damage_and_repair
from tidemill.llm.decontamination import leaks
from tidemill.llm.html_text import extract_text
from tidemill.llm.language_id import identify_languages
from tidemill.llm.license_scan import BASE, TEMPLATES, license_scan, template_pattern
from tidemill.llm.quality import FAILED, MAX_RATE, quality_rules
from tidemill.llm.ranked_search import ranked_search
from tidemill.llm.secret_scan import secret_scan
from tidemill.llm.sharding import minimax_shards
from tidemill.llm.simhash import simhash_components
from tidemill.llm.suffix_dedup import repeated_strings
from tidemill.llm.token_counts import token_counts

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf_dir):
    return repeated_strings(table(spark, sf_dir, "documents"), length=400)


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    return minimax_shards(table(spark, sf_dir, "documents"), shards=8)


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents"))


_SPACE = r"[^\x20\x09-\x0D]"


@query(
    "op6_quality_rules",
    rf"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS words
        FROM documents
    ),
    tokens AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts),
    windows AS (
        SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM tokens
        WINDOW p AS (PARTITION BY r ORDER BY i)
    ),
    repeated AS (
        SELECT r, unnest([i, i + 1, i + 2]) AS i
        FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL)
        WHERE n > 1
    ),
    marked AS (SELECT r, count(DISTINCT i) AS n FROM repeated GROUP BY r),
    lengths AS (SELECT r, sum(length(w)) AS n FROM tokens GROUP BY r),
    lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts),
    dups AS (
        SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{_SPACE}') GROUP BY r
    ),
    measured AS (
        SELECT doc_id, source, len(words)::BIGINT AS n_words, coalesce(lengths.n, 0)::BIGINT AS word_chars,
               len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
               coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(marked.n, 0)::BIGINT AS n_repeat_words
        FROM texts LEFT JOIN lengths USING (r) LEFT JOIN dups USING (r) LEFT JOIN marked USING (r)
    ),
    hosts AS (
        SELECT source AS host, sum(({FAILED})::INT) AS f, count(*) AS n
        FROM measured WHERE source IS NOT NULL GROUP BY source
    ),
    moments AS (
        SELECT avg(f / n) AS m, sum(n) AS n, avg(f / n) * (1 - avg(f / n)) AS most, avg(1 / n) AS a, var_pop(f / n) AS v FROM hosts
    ),
    prior AS (
        SELECT m, CASE WHEN v - a * most > 0 THEN greatest((1 - a) * most / (v - a * most) - 1, 0) ELSE n END AS strength
        FROM moments
    ),
    bad AS (SELECT host FROM hosts, prior WHERE (f + m * strength) / (n + strength) > {MAX_RATE}),
    judged AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
        FROM measured LEFT JOIN bad ON source = host
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND host IS NULL AS kept
    FROM judged
    """,
)
def op6_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))


@query("op8_html_text")
def op8_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


@query("op9_bpe_round_trip")
def op9_bpe_round_trip(spark, sf_dir):
    return bpe_round_trip(table(spark, sf_dir, "documents"))


@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir):
    return damage_and_repair(table(spark, sf_dir, "conversations"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _first_words():
    """Each base phrase as conditions on a list of words at a place ``i``."""
    for label, phrase in BASE:
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        yield f"SELECT r, i - 1 AS place, '{label}' AS label FROM places WHERE {same}"


def _accepted():
    for label, template in TEMPLATES:
        yield f"SELECT r, '{label}' AS label FROM texts WHERE regexp_matches(line, '{template_pattern(template)}')"


@query(
    "op12_license_scan",
    rf"""
    WITH split AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM documents
    ),
    texts AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line FROM split),
    places AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM texts),
    base AS ({" UNION ALL ".join(_first_words())}),
    counted AS (
        SELECT r, count(*)::BIGINT AS n, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word,
               array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
        FROM base GROUP BY r
    ),
    accepted AS ({" UNION ".join(_accepted())}),
    labelled AS (
        SELECT r, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
        FROM (SELECT r, label FROM base UNION SELECT r, label FROM accepted) GROUP BY r
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word,
           coalesce(counted.labels, '') AS base_labels, coalesce(labelled.labels, '') AS labels,
           CASE WHEN r IN (SELECT r FROM accepted) THEN 1.0 WHEN n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
    FROM texts LEFT JOIN counted USING (r) LEFT JOIN labelled USING (r)
    """,
)
def op12_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


_TERMS = rf"unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"


@query(
    "op13_ranked_search",
    rf"""
    WITH found AS (SELECT r, doc_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS r, * FROM documents)),
    counted AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM found GROUP BY r, doc_id, term),
    lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM counted GROUP BY r),
    totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
    frequencies AS (SELECT term, count(*)::BIGINT AS df FROM counted GROUP BY term),
    wanted AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
    scored AS (
        SELECT item_id, r, doc_id,
               sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
                   * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
        FROM wanted JOIN counted USING (term) JOIN frequencies USING (term) JOIN lengths USING (r), totals
        GROUP BY item_id, r, doc_id
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
)
def op13_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
