"""License scans by template markup.

A template is license wording with marked regions: ``<<beginOptional>> ... <<endOptional>>`` may be
left out, ``<<var;words=a-b>>`` stands for a to b words of any kind, ``<<var;oneof=x|y z>>`` for one of
the listed wordings. All templates compile into one automaton over words, whose sets of states are
numbered as texts reach them. A text is accepted where every mandatory word stands exactly, in order.
The documents stay where they are; a table of word pairs tells where the automaton has to start.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridmill.llm.common import binary, map_arrow, pieces, table
from gridmill.llm.decontaminate import words_of


class Template(NamedTuple):
    label: str
    markup: str
    base: bool = False


MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies
or substantial portions of the software"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<var;words=0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<var;words=0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution"""
GNU = """under the <<beginOptional>>terms of the<<endOptional>> gnu {} license <<beginOptional>>as published by the free software foundation
<<endOptional>> <<beginOptional>>either<<endOptional>> <<var;oneof=version|v>> {}"""
CREATIVE = "under <<beginOptional>><<var;oneof=a|the>><<endOptional>> creative commons attribution {} <<beginOptional>>{}<<endOptional>> <<beginOptional>>international<<endOptional>> license"

#: The base phrases, and wording of well-known public licenses.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", MIT),
    Template("isc", "permission to use copy modify <<beginOptional>>and<<endOptional>> <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    Template("bsd-2-clause", BSD),
    Template("bsd-3-clause", BSD + " <<var;words=0-1>> neither the name of <<var;words=1-20>> nor the names of <<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote products derived from this software"),
    Template("apache-2", "licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>> you may not use this file except in compliance with the license"),
    Template("gpl-2", GNU.format("general public", "2")),
    Template("gpl-3", GNU.format("general public", "3")),
    Template("lgpl", GNU.format("lesser general public", "<<var;oneof=2|2 1|3>>")),
    Template("agpl-3", GNU.format("affero general public", "3")),
    Template("mpl-2", "subject to the terms of the mozilla public license <<var;oneof=v|version>> 2 0"),
    Template("cc-by", CREATIVE.format("", "4 0")),
    Template("cc-by-sa", CREATIVE.format("<<var;oneof=share alike|sharealike>>", "4 0")),
    Template("cc-by-nc", CREATIVE.format("<<var;oneof=non commercial|noncommercial>>", "4 0")),
    Template("cc-by-sa", "cc by sa <<var;oneof=2 0|2 5|3 0|4 0>>"),
    Template("cc0", "cc0 1 0 <<beginOptional>>universal<<endOptional>>"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("identified", "spdx license identifier <<var;words=1-3>>"),
    Template("all-rights-reserved", "copyright <<beginOptional>>c<<endOptional>> <<var;words=1-8>> all rights reserved"),
)

MARK = re.compile(r"<<\s*(beginOptional|endOptional|var;[^<>]*)>>|[^\s<>]+")
#: Most words that a region without wording of its own may stand for.
MOST_WORDS = 64

#: ("word", w), ("optional", parts), ("any", least, most) or ("oneof", wordings).
Part = tuple


def parts_of(markup: str) -> list[Part]:
    """The parts of a template; wording is lower-cased in A-Z and split as documents are."""
    stack: list[list[Part]] = [[]]
    for m in MARK.finditer(markup):
        mark = m[1]
        if mark is None:
            stack[-1] += [("word", w) for w in words_of(m[0].encode())]
        elif mark == "beginOptional":
            stack.append([])
        elif mark == "endOptional":
            if len(stack) == 1:
                raise ValueError(f"endOptional without beginOptional: {markup!r}")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            name, _, value = mark.partition(";")[2].partition("=")
            if name == "words":
                least, most = map(int, value.split("-"))
                if not 0 <= least <= most <= MOST_WORDS or most == 0:
                    raise ValueError(f"a region takes up to {MOST_WORDS} words: {mark!r}")
                stack[-1].append(("any", least, most))
            elif name == "oneof":
                stack[-1].append(("oneof", [words_of(w.encode()) for w in value.split("|")]))
            else:
                raise ValueError(f"unknown region {mark!r}")
    if len(stack) > 1:
        raise ValueError(f"beginOptional without endOptional: {markup!r}")
    if not stack[0] or stack[0][0][0] != "word":
        raise ValueError(f"a template begins with a mandatory word: {markup!r}")
    return stack[0]


class Automaton:
    """All templates as one automaton over word numbers; sets of states are bits of an integer.

    ``step`` keeps what it has found, so the deterministic automaton grows with the texts' wording only.
    """

    def __init__(self, templates: tuple[Template, ...]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int | None, int]]] = []
        starts, ends = [], []
        for t in templates:
            start = self.state()
            starts.append(start)
            ends.append(self.add(parts_of(t.markup), start))
        self.reach = [self.closure(s) for s in range(len(self.empty))]
        self.start = functools.reduce(int.__or__, (self.reach[s] for s in starts), 0)
        self.ends = [1 << e for e in ends]
        self.known: dict[int, dict[int, int]] = {}
        self.told: dict[int, tuple[int, ...]] = {}
        self.pairs = self.pairs_that_start()

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def move(self, at: int, word: bytes | None) -> int:
        to = self.state()
        self.moves[at].append((None if word is None else self.vocabulary.setdefault(word, len(self.vocabulary) + 1), to))
        return to

    def add(self, parts: list[Part], at: int) -> int:
        """The state behind ``parts`` that begin in the state ``at``."""
        for kind, *given in parts:
            if kind == "word":
                at = self.move(at, given[0])
            elif kind == "optional":
                end = self.add(given[0], at)
                self.empty[at].append(end)
                at = end
            elif kind == "any":
                least, most = given
                passed = []
                for k in range(most):
                    if k >= least:
                        passed.append(at)
                    at = self.move(at, None)
                for s in passed:
                    self.empty[s].append(at)
            else:
                end = self.state()
                for wording in given[0]:
                    last = functools.reduce(self.move, wording, at)
                    self.empty[last].append(end)
                at = end
        return at

    def closure(self, state: int) -> int:
        seen, todo = 1 << state, [state]
        while todo:
            for s in self.empty[todo.pop()]:
                if not seen >> s & 1:
                    seen |= 1 << s
                    todo.append(s)
        return seen

    def step(self, states: int, word: int) -> int:
        """The states after ``word``; 0 where nothing is left. Word 0 is one that no template has."""
        after = self.known.setdefault(states, {})
        if word not in after:
            to, rest = 0, states
            while rest:
                low = rest & -rest
                rest ^= low
                for asked, s in self.moves[low.bit_length() - 1]:
                    if asked is None or asked == word:
                        to |= self.reach[s]
            after[word] = to
        return after[word]

    def accepted(self, states: int) -> tuple[int, ...]:
        """The numbers of the templates that end here."""
        if states not in self.told:
            self.told[states] = tuple(k for k, e in enumerate(self.ends) if states & e)
        return self.told[states]

    def pairs_that_start(self) -> np.ndarray:
        """[first, second]: whether some template may begin with these two words."""
        n = len(self.vocabulary) + 1
        out = np.zeros((n, n), bool)
        for first in range(1, n):
            if states := self.step(self.start, first):
                out[first] = [bool(self.accepted(states)) or self.step(states, second) != 0 for second in range(n)]
        return out

    def numbers(self, words: list[bytes]) -> list[int]:
        get = self.vocabulary.get
        return [get(w, 0) for w in words]

    def regions(self, numbers: list[int], starts: list[int]) -> list[tuple[int, int, int]]:
        """(start, template, end) of the accepted regions: of each template leftmost, longest, not overlapping."""
        found: list[tuple[int, int, int]] = []
        until: dict[int, int] = {}
        for i in starts:
            states, j, best = self.start, i, {}
            while j < len(numbers) and (states := self.step(states, numbers[j])):
                j += 1
                for t in self.accepted(states):
                    best[t] = j
            for t, end in best.items():
                if until.get(t, 0) <= i:
                    until[t] = end
                    found.append((i, t, end))
        return sorted(found)


@functools.lru_cache(8)
def automaton(templates: tuple[Template, ...]) -> Automaton:
    """Compiled once in each worker."""
    return Automaton(templates)


#: Bytes of texts whose words are looked at together.
BLOCK_BYTES = 1 << 20
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def found_in(machine: Automaton, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The number of words and the regions of each text."""
    numbers = [machine.numbers(words_of(t)) for t in texts]
    # A word that no template has stands behind each text, so no pair reaches over its end.
    cuts = np.cumsum([0, *(len(n) + 1 for n in numbers)])
    whole = np.zeros(cuts[-1] + 1, np.int32)
    for at, n in zip(cuts, numbers):
        whole[at : at + len(n)] = n
    starts = np.flatnonzero(machine.pairs[whole[:-1], whole[1:]])
    bounds = np.searchsorted(starts, cuts)
    for k, n in enumerate(numbers):
        yield len(n), machine.regions(n, (starts[bounds[k] : bounds[k + 1]] - cuts[k]).tolist())


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts the places of the base templates, ``first_word`` and ``last_word`` are their first
    and last start. ``score`` is the largest share of the words that one template's regions cover,
    ``spans`` are label:start:end in words. Null and empty texts have no words and score 0. A text of any
    length is scanned whole. Repeated rows and null doc_ids are scanned like others, further columns are
    not read, an empty table gives an empty result.
    """

    def row(n: int, regions: list[tuple[int, int, int]]) -> tuple:
        starts = [s for s, t, _ in regions if templates[t].base]
        labels = lambda some: ",".join(sorted({templates[t].label for _, t, _ in some}))
        covered: dict[int, int] = {}
        for s, t, e in regions:
            covered[t] = covered.get(t, 0) + e - s
        return n, len(starts), min(starts, default=None), max(starts, default=None), labels(r for r in regions if templates[r[1]].base), labels(regions), max(covered.values(), default=0) / max(n, 1), ",".join(f"{templates[t].label}:{s}:{e}" for s, t, e in regions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(templates)
        for batch in batches:
            texts = binary(batch.column(1))
            rows = [row(n, regions) for i, j in pieces(texts, BLOCK_BYTES) for n, regions in found_in(machine, texts.slice(i, j - i).to_pylist())]
            columns = zip(*rows) if rows else [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, KINDS))], names=["doc_id", *NAMES])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


NAMES = [c.split()[0] for c in RESULT.split(", ")]
KINDS = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in RESULT.split(", ")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def expression(parts: list[Part]) -> str:
    """The parts as a regular expression over words that each stand between bars."""
    out = ""
    for kind, *given in parts:
        if kind == "word":
            out += rf"\|{given[0].decode()}\|"
        elif kind == "optional":
            out += f"(?:{expression(given[0])})?"
        elif kind == "any":
            out += rf"(?:\|[^|]+\|){{{given[0]},{given[1]}}}"
        else:
            # The longest wording first: SQL takes the first that fits, the automaton the longest.
            out += "(?:" + "|".join(expression([("word", w) for w in x]) for x in sorted(given[0], key=len, reverse=True)) + ")"
    return out


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL: each template as a regular expression over the joined words, searched for in every document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = " UNION ALL ".join(
        f"SELECT k, {n} AS t, '{t.label}' AS label, {t.base} AS base, regexp_extract_all(s, '{expression(parts_of(t.markup))}') AS m, s FROM w" for n, t in enumerate(templates)
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    w AS (SELECT k, array_to_string(list_transform(words, lambda x: '|' || x || '|'), '') AS s FROM d WHERE len(words) > 0),
    found AS MATERIALIZED (SELECT * FROM ({found}) WHERE len(m) > 0),
    covered AS (SELECT k, t, label, base, sum((length(x) - length(replace(x, '|', ''))) // 2) AS n FROM (SELECT k, t, label, base, unnest(m) AS x FROM found) GROUP BY ALL),
    told AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, max(n) AS most FROM covered GROUP BY k),
    places AS (SELECT k, list_sum(list_transform(pieces[1:i], lambda x: (length(x) - length(replace(x, '|', ''))) // 2)) + (i - 1) * size AS word
        FROM (SELECT k, (length(m[1]) - length(replace(m[1], '|', ''))) // 2 AS size, string_split(s, m[1]) AS pieces FROM found WHERE base), unnest(range(1, len(pieces))) u(i)),
    base AS (SELECT k, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word FROM places GROUP BY k)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(most, 0)::DOUBLE / greatest(len(words), 1) AS score
    FROM d LEFT JOIN told ON told.k = d.k LEFT JOIN base ON base.k = d.k"""
