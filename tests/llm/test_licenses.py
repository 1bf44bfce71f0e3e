"""The automaton of all templates against regular expressions of each, and planted licences."""

import random
import re

import pytest

from tidemill.llm import license_scan as L

TEMPLATES = (
    ("a", "one <<beginOptional>>two<<endOptional>> three"),
    ("b", "one <<var;x;1-3>> four <<beginOptional>>five <<beginOptional>>six<<endOptional>> one<<endOptional>>"),
    ("c", "<<beginOptional>>two<<endOptional>> three <<var;y;0-2>> two two"),
    ("d", "six six"),
)
WORDS = "one two three four five six é seven".split()


def scan_plainly(text):
    """Longest matches at each word, unless within an earlier one of the template."""
    line, found = " " + " ".join(text.split()) + " ", []
    starts = [m.start() for m in re.finditer(r" (?=[^ ])", line)]
    for number, (_, template) in enumerate(TEMPLATES):
        end = -1
        for i, at in enumerate(starts):
            ends = [j for j in range(i + 1, len(starts) + 1) if re.fullmatch(L.template_pattern(template), line[at : (starts + [len(line) - 1])[j] + 1])]
            if ends and i >= end:
                end = max(ends)
                found.append((number, i, end))
    return sorted(found, key=lambda f: (f[1], f[0]))


def test_automaton_equals_regular_expressions():
    rng, automaton, some = random.Random(1), L.Automaton(TEMPLATES), 0
    for _ in range(1500):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14)))
        starts = [m.start() for m in re.finditer(rb"[^ ]+", L.plain(text))]
        ends = [m.end() for m in re.finditer(rb"[^ ]+", L.plain(text))]
        got = [(t, starts.index(a), ends.index(b) + 1) for t, a, b in automaton.scan(L.plain(text))]
        assert got == scan_plainly(text), text
        some += len(got)
    assert some > 500


@pytest.mark.parametrize("template", ["<<var;x;0-3>> a", "<<beginOptional>>a<<endOptional>>", "a <<beginOptional>>b", "<<other>> a", "a <<var;x;3-1>>"])
def test_templates_that_cannot_be_compiled(template):
    with pytest.raises(ValueError):
        L.Automaton((("x", template),))


def test_whole_licences_with_their_regions(spark):
    fill = lambda template: re.sub(r"<<var.*?>>", "the Regents of\n Berkeley", re.sub(r"<<(begin|end)Optional>>", " ", template))
    rows = [(i, f"Copyright (c) 2020\n\n{fill(template)} The end.") for i, (_, template) in enumerate(L.TEMPLATES)]
    rows += [(100, fill(L.TEMPLATES[0][1]).replace("copy, modify", "modify, copy")), (101, None), (102, ""), (103, "GNU GENERAL PUBLIC LICENSE " * 3)]
    rows += [(104, "x " * 300_000 + "apache-license"), (None, "mit license"), (None, "mit license")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("places", L.F.lit(1))
    found = L.license_scan(table).collect()
    got = {r.doc_id: r for r in found}
    for i, (label, _) in enumerate(L.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0, L.TEMPLATES[i]
    assert "BSD-2-Clause" not in got[5].labels
    assert (got[100].labels, got[100].score) == ("", 0.0)
    assert tuple(got[101])[1:] == tuple(got[102])[1:] == (0, 0, None, None, "", "", 0.0)
    assert tuple(got[103])[1:] == (12, 3, 0, 8, "gpl", "gpl", 0.5)
    assert tuple(got[104])[1:] == (300_002, 1, 300_000, 300_000, "apache", "apache", 0.5)
    assert sum(r.doc_id is None for r in found) == 2
    assert L.license_scan(table.limit(0)).count() == 0
