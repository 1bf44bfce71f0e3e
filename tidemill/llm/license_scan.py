"""Licences in texts, found by templates with optional and replaceable regions.

A template is wording in which ``<<beginOptional>>`` ... ``<<endOptional>>`` encloses what may be
left out and ``<<var;name;least-most>>`` stands for any words of such a number. Templates are
compiled together into one automaton over words, whose deterministic states are made when first
needed. It starts wherever a word stands that a template may begin with, and accepts where the
mandatory wording is there word by word.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows

#: Deterministic states that are kept from one text to the next; beyond it they are made anew.
MAX_STATES = 50_000

# Phrases that are looked for in any case, and their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# The wording of public licences and of the usual references to them.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\"<<beginOptional>>,<<endOptional>> WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
    " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above"
    " copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>>"
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY <<var;holder;1-20>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT"
    " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_CC = "<<beginOptional>>is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>>"
TEMPLATES = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright"
        " notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included"
        f" in all copies or substantial portions of the Software. {_WARRANTY}",
    ),
    ("MIT", "<<beginOptional>>is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("MIT", "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD-2-Clause", f"{_BSD_CONDITIONS} {_BSD_WARRANTY}"),
    (
        "BSD-3-Clause",
        f"{_BSD_CONDITIONS} <<beginOptional>>3<<endOptional>> Neither the name of <<var;holder;1-20>> nor the names of its"
        " contributors may be used to endorse or promote products derived from this software without specific prior written"
        f" permission. {_BSD_WARRANTY}",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use this file except"
        " in compliance with the License<<endOptional>>",
    ),
    ("GPL-2.0", "under the terms of the GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>"
                "<<beginOptional>>; either<<endOptional>> version 2"),
    ("GPL-3.0", "under the terms of the GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>"
                "<<beginOptional>>, either<<endOptional>> version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("CC-BY-4.0", f"{_CC} <<beginOptional>>Attribution<<endOptional>> <<beginOptional>>CC BY<<endOptional>> 4.0"),
    ("CC-BY-SA-4.0", f"{_CC} CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", f"{_CC} CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", f"{_CC} Attribution-ShareAlike 4.0"),
    ("CC-BY-NC-4.0", f"{_CC} Attribution-NonCommercial 4.0"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
        " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
        " commercial or non-commercial, and by any means.",
    ),
)
# Bytes of words once A-Z are in lower case.
_PLAIN = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_MARKUP = re.compile(r"<<(.*?)>>", re.S)
_WORD = re.compile(rb"[^ ]+")


def plain(text: str | None) -> bytes:
    """The text's bytes with A-Z in lower case and spaces for all that is in no word."""
    return (text or "").encode().translate(_PLAIN)


def parse(template: str) -> list:
    """The parts of a template: words, ``(least, most)`` of replaceable regions, lists of optional parts."""
    parts, open_parts = [], []
    for i, piece in enumerate(_MARKUP.split(template)):
        if i % 2 == 0:
            parts += plain(piece).split()
        elif piece == "beginOptional":
            open_parts.append(parts)
            parts = []
        elif piece == "endOptional" and open_parts:
            inner, parts = parts, open_parts.pop()
            if inner:
                parts.append(inner)
        elif (found := re.fullmatch(r"var;[^;]*;(\d+)-(\d+)", piece)) and int(found[1]) <= int(found[2]):
            parts.append((int(found[1]), int(found[2])))
        else:
            raise ValueError(f"not a template's markup: <<{piece}>>")
    if open_parts:
        raise ValueError("a template's optional region is not closed")
    return parts


class Automaton:
    """All templates as one automaton over words."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.templates = templates
        self.on_word: list[dict[bytes, int]] = []  # of each state, the state after a certain word
        self.on_any: list[int] = []  # or after any word; -1: none
        self.free: list[list[int]] = []  # states reached without a word
        self.accepted: dict[int, int] = {}  # template by its last state
        starts = []
        for number, (_, template) in enumerate(templates):
            starts.append(self._state())
            end = self._compile(parse(template), starts[-1])
            if end in self._closure([starts[-1]]):
                raise ValueError("a template without mandatory words accepts everything")
            self.accepted[end] = number
        first = self._closure(starts)
        if any(self.on_any[s] >= 0 for s in first):
            raise ValueError("a template may not begin with a replaceable region")
        words = {w for s in first for w in self.on_word[s]}
        self.starts = re.compile(rb"(?<![^ ])(?:" + b"|".join(sorted(map(re.escape, words), key=len, reverse=True)) + rb")(?![^ ])")
        self.known = {w for words in self.on_word for w in words}
        self.begin = first
        self._restart()

    def _restart(self):
        # deterministic states: number by set, templates accepted in them, moves by word (None: any other word)
        self.numbers, self.sets, self.accepts, self.moves = {}, [], [], []
        self.first = self._number(self.begin)

    def _state(self):
        self.on_word.append({})
        self.on_any.append(-1)
        self.free.append([])
        return len(self.free) - 1

    def _compile(self, parts, state):
        """Append the parts after ``state``; the state after them."""
        for part in parts:
            after = self._state()
            if isinstance(part, bytes):
                self.on_word[state][part] = after
            elif isinstance(part, list):
                inner = self._state()
                self.free[state] += [inner, after]
                self.free[self._compile(part, inner)].append(after)
            else:
                for i in range(part[1]):
                    step = self._state()
                    if i >= part[0]:
                        self.free[state].append(after)
                    self.on_any[state], state = step, step
                self.free[state].append(after)
            state = after
        return state

    def _closure(self, states):
        seen, waiting = set(states), list(states)
        while waiting:
            fresh = [s for s in self.free[waiting.pop()] if s not in seen]
            seen.update(fresh)
            waiting += fresh
        return frozenset(seen)

    def _number(self, states):
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.accepts.append([self.accepted[s] for s in states if s in self.accepted])
            self.moves.append({})
        return self.numbers[states]

    def move(self, number: int, word: bytes) -> int:
        """The deterministic state after a word; -1 where nothing can be accepted any more."""
        word = word if word in self.known else None
        after = self.moves[number].get(word)
        if after is None:
            states = [t for s in self.sets[number] if (t := self.on_word[s].get(word, -1)) >= 0]
            states += [t for s in self.sets[number] if (t := self.on_any[s]) >= 0]
            after = self.moves[number][word] = self._number(self._closure(states)) if states else -1
        return after

    def scan(self, text: bytes) -> list[tuple[int, int, int]]:
        """``(template, start, end)`` in a plain text, as byte offsets, by start: the longest from each
        start, unless it begins within an earlier one of its template."""
        if len(self.sets) > MAX_STATES:
            self._restart()
        found, ends = [], [0] * len(self.templates)
        for start in self.starts.finditer(text):
            number, longest = self.first, {}
            for word in _WORD.finditer(text, start.start()):
                number = self.move(number, word[0])
                if number < 0:
                    break
                for template in self.accepts[number]:
                    longest[template] = word.end()
            for template, end in sorted(longest.items()):
                if start.start() >= ends[template]:
                    ends[template] = end
                    found.append((template, start.start(), end))
        return found


def license_places(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = BASE + TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_words`` and ``places``, a list of ``(template, label, start, end)``.

    ``template`` is a number in ``templates``, pairs of label and template; ``start`` and ``end``
    (exclusive) count words from 0. Words are runs of digits, ASCII letters and all other
    characters beyond ASCII; only A-Z are put in lower case. Places are in order of start and
    template; one that begins within an earlier place of its template is part of it.

    Null and empty texts have no words and no places. Null ids and repeated rows are rows like
    others; other columns are not read; an empty table gives an empty result. A map without
    shuffle: texts are read whole, whatever their length.
    """

    def make():
        automaton = Automaton(templates)

        def run(ids, texts):
            counts, places = [], []
            for text in map(plain, texts):
                word = np.frombuffer(b" " + text, np.uint8) != 0x20
                starts = np.flatnonzero(word[1:] & ~word[:-1])
                found = automaton.scan(text)
                counts.append(len(starts))
                firsts, ends = (np.searchsorted(starts, [f[i] for f in found]).tolist() for i in (1, 2))
                places.append(
                    [{"template": t, "label": templates[t][0], "start": a, "end": b} for (t, _, _), a, b in zip(found, firsts, ends)]
                )
            return ids, counts, places

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words bigint, places array<struct<template: int, label: string, start: bigint, end: bigint>>"
    return map_rows(docs, [F.col(id_col), F.col(text_col)], schema, make)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the least
    and greatest of their starts, null without any. ``score`` is 1 where a licence's or
    reference's whole mandatory wording is there, 0.5 where base phrases are, and 0 otherwise.
    For nulls, long texts and repeated rows see ``license_places``.
    """
    base = F.filter("places", lambda p: p["template"] < len(BASE))
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return license_places(docs, id_col=id_col, text_col=text_col).select(
        id_col, "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.when(F.size("places") > F.size(base), 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
    )


def template_pattern(template: str) -> str:
    """A regular expression over words with a space before each that accepts what the template accepts."""

    def of(parts):
        out = ""
        for part in parts:
            if isinstance(part, bytes):
                out += " " + part.decode()
            elif isinstance(part, list):
                out += f"(?:{of(part)})?"
            else:
                out += f"(?: [^ ]+){{{part[0]},{part[1]}}}"
        return out

    return of(parse(template)) + " "
