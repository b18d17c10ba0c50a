"""License scan with a generalised suffix automaton over license words.

All templates share one automaton of word ids.  A file is streamed through it once: after
each word the state and the match length are the longest template substring that ends
there (the matching statistics).  Maximal long matches are chained per template, in the
template's order, into spans; a template covered well enough gives its label.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lotgrid.llm.common import map_texts

# Phrases that give the base labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Public wording of common licenses, label and text.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ),
    ("apache", "licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "this work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "mit",
        'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of '
        "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable "
        "for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection "
        "with the Software or the use or other dealings in the Software.",
    ),
    (
        "bsd",
        'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not '
        "limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the "
        "copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages "
        "(including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) "
        "however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
        "arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# Production parameters.
MIN_MATCH = 4  # words of a match that counts, or the whole of a shorter template
MIN_COVERAGE = 0.75  # share of a template's words that its chained matches have to cover
MAX_GAP = 40  # file words between two matches of one chain

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8 after lower-casing A-Z: ASCII letters and digits and all beyond ASCII."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class Automaton:
    """Suffix automaton of several word sequences, as plain lists indexed by state."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    steps: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])  # state -> template -> all its ends, ascending
    phrases: list[tuple[tuple[int, int], ...]] = field(default_factory=list)  # state -> (words, phrase)

    def add(self, template: int, sequence: list[int]) -> None:
        last = 0
        for at, word in enumerate(sequence, 1):
            last = self._extend(last, word)
            self.ends[last].setdefault(template, []).append(at)

    def _state(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.steps) - 1

    def _split(self, p: int, word: int) -> int:
        """The state for the longest string of ``p`` followed by ``word``."""
        q = self.steps[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.steps[q]))
        self.link[q] = clone
        while p >= 0 and self.steps[p].get(word) == q:
            self.steps[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.steps[last]:  # another template went this way
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.steps[p]:
            self.steps[p][word] = new
            p = self.link[p]
        self.link[new] = self._split(p, word) if p >= 0 else 0
        return new

    def finish(self, phrases: list[list[int]]) -> None:
        """Hand template positions up the suffix links and mark where base phrases end."""
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for template, at in self.ends[s].items():
                up = self.ends[self.link[s]]
                up[template] = sorted({*at, *up.get(template, ())})
        own: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(phrases):
            s = 0
            for word in sequence:
                s = self.steps[s][word]
            own.setdefault(s, []).append((len(sequence), k))
        marks: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for s in sorted(range(len(self.link)), key=lambda s: self.length[s]):
            marks[s] = (marks[self.link[s]] if s else ()) + tuple(own.get(s, ()))
        self.phrases = marks


def build(templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> tuple[Automaton, list[int]]:
    """Automaton over templates and base phrases, and the templates' word counts."""
    templates = TEMPLATES if templates is None else templates
    phrases = BASE_PHRASES if phrases is None else phrases
    a = Automaton()

    def ids(text: str) -> list[int]:
        return [a.vocabulary.setdefault(w, len(a.vocabulary)) for w in words(text)]

    sequences, spoken = [ids(t) for _, t in templates], [ids(p) for p in phrases]
    for k, sequence in enumerate([*sequences, *spoken]):
        a.add(k, sequence)
    a.finish(spoken)
    return a, [len(s) for s in sequences]


def scan(tokens: list[bytes], a: Automaton, sizes: list[int], min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, max_gap: int = MAX_GAP):
    """``(phrase places, spans)`` of one file.

    A place is ``(first word, phrase)``.  A span is ``(template, first word, last word,
    coverage)``: the best chain of a template that reaches the coverage.
    """
    places: list[tuple[int, int]] = []
    matches: list[tuple[int, int, int]] = []  # end word, length, state
    ids = list(map(a.vocabulary.get, tokens))
    steps, link, length, marks = a.steps, a.link, a.length, a.phrases
    state = size = 0
    for at, word in enumerate(ids):
        if word is None:
            if size >= 2:
                matches.append((at - 1, size, state))
            state = size = 0
            continue
        was, was_size = state, size
        while state and word not in steps[state]:
            state = link[state]
            size = length[state]
        if word in steps[state]:
            state, size = steps[state][word], size + 1
        else:
            state = size = 0
        if was_size >= 2 and size <= was_size:
            matches.append((at - 1, was_size, was))
        for n, phrase in marks[state]:
            if size >= n:
                places.append((at - n + 1, phrase))
    if size >= 2:
        matches.append((len(ids) - 1, size, state))
    chains: dict[int, list[int]] = {}  # template -> [start, last word, template end, covered]
    best: dict[int, tuple[int, int, int, float]] = {}

    def close(template: int) -> None:
        start, last, _, covered = chains.pop(template)
        share = min(1.0, covered / sizes[template])
        if share >= min_coverage and share > best.get(template, (0, 0, 0, 0.0))[3]:
            best[template] = (template, start, last, share)

    for end, n, s in matches:
        for template, stops in a.ends[s].items():
            if template >= len(sizes) or n < min(min_match, sizes[template]):
                continue
            chain = chains.get(template)
            # The nearest place further on in the template continues the chain, so that a repeated
            # passage is read in its turn.
            ahead = bisect_right(stops, chain[2]) if chain else 0
            if chain and (end - n - chain[1] > max_gap or ahead == len(stops)):
                close(template)
                chain = None
            if chain:
                stop = stops[ahead]
                chain[3] += stop - max(stop - n, chain[2])
                chain[1], chain[2] = end, stop
            else:
                chains[template] = [end - n + 1, end, stops[0], n]
    for template in list(chains):
        close(template)
    return places, sorted(best.values())


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """License findings of every row of ``docs(doc_id, text)``, in the row's order of columns:

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score``.
    Files are independent, so nothing is shuffled.  A null text is empty; without a base
    phrase the word positions are null and the labels empty; the score is the largest
    coverage of a template, and 1 where a base phrase stands.  Of chains of one template with
    equal coverage the first stays.  Files of any length are streamed whole, repeated rows
    are scanned each.
    """
    used, spoken = TEMPLATES if templates is None else templates, list((BASE_PHRASES if phrases is None else phrases).values())
    automaton, sizes = build(templates, phrases)

    def run(texts: list[str | None]) -> tuple[None, dict[str, list]]:
        out: dict[str, list] = {name: [] for name in made}
        for source in texts:
            tokens = words(source)
            places, spans = scan(tokens, automaton, sizes)
            starts = [p for p, _ in places]
            base = {spoken[k] for _, k in places}
            labels = base | {used[t][0] for t, *_ in spans}
            found = [{"label": used[t][0], "template": t, "first": f, "last": e, "coverage": c} for t, f, e, c in spans]
            score = 1.0 if places else max((s[3] for s in spans), default=0.0)
            row = (len(tokens), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), found, score)
            for name, value in zip(made, row, strict=True):
                out[name].append(value)
        return None, out

    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])
    made = {c: ("long", pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")}
    made |= {c: ("string", pa.string()) for c in ("base_labels", "labels")}
    made |= {"spans": ("array<struct<label: string, template: int, first: long, last: long, coverage: double>>", pa.list_(span)), "score": ("double", pa.float64())}
    return map_texts(docs, ["doc_id"], text, made, run)
