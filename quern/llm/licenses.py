"""License scans by template markup.

A template is wording with regions: ``<<opt>> words <</opt>>`` may be left out, ``<<var:n>>`` stands for
up to n words of any kind, ``<<a|b c>>`` for one of the alternatives. Each template compiles into a
token automaton; a text matches where its words pass from the first to the last state, so that
all mandatory wording stands there exactly and in order.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; all else separates.

Defined results: a null or empty text has no words and no places, empty label strings and score 0;
very long texts are read whole, in linear time but for the templates they hold; rows are judged
one by one (ties, repeated rows, empty tables) and other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import map_batches, slabs, with_text
from quern.llm.wordhash import ALNUM, LOWER, spans

#: Base phrases: label, wording. All of their places are counted.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Templates of the method: label, weight in the score, wording with regions.
TEMPLATES = (
    ("mit", 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software and <<opt>> associated <</opt>> documentation files <<opt>> the software <</opt>> to deal in the software without restriction"),
    ("mit", 0.6, "<<released|licensed|distributed|available>> under the <<opt>> terms of the <</opt>> mit <<opt>> open source <</opt>> <<license|licence>>"),
    ("apache-2", 0.9, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", 0.6, "licensed under the apache license version <<opt>> number <</opt>> 2 <<opt>> 0 <</opt>>"),
    ("bsd", 0.9, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", 0.9, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", 0.9, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", 0.9, "this is free and unencumbered software released into the public domain"),
    ("gpl", 0.6, "licensed under the <<opt>> terms of the <</opt>> gnu <<opt>> lesser <</opt>> <<opt>> affero <</opt>> general public license <<opt>> version <<1|2|3>> <</opt>>"),
    ("gpl", 0.9, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", 0.8, "this source code form is subject to the terms of the mozilla public license v <<opt>> ersion <</opt>> 2 0"),
    ("cc-by-nc", 0.6, "licensed under <<opt>> a <</opt>> <<cc by nc|creative commons attribution <<opt>> non <</opt>> <<noncommercial|commercial>>>> <<opt>> sa <</opt>> <<opt>> nd <</opt>> <<1|2|3|4>> 0"),
    ("all-rights-reserved", 0.5, "copyright <<opt>> c <</opt>> <<var:12>> all rights reserved"),
)

# Whole licence texts as templates; numbers of clauses may be left out, names of holders are replaceable.
TEXTS = (
    ("mit", 0.98, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>> including the next paragraph <</opt>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<noninfringement|non infringement>> in no event shall the <<authors or copyright holders|copyright holders|authors>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", 0.98, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var:6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", 0.98, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>> 1 <</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>> 2 <</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>> <<opt>> 3 <</opt>> neither the name of <<var:12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission <</opt>> this software is provided by <<var:8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", 0.98, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt>> 1 <</opt>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an <<acknowledgment|acknowledgement>> in the product documentation would be appreciated but is not required <<opt>> 2 <</opt>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<opt>> 3 <</opt>> this notice may not be removed or altered from any source distribution"),
    ("apache-2", 0.98, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<http|https>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
)
TEMPLATES += TEXTS

BASE_WEIGHT = 0.5
_TOKEN = re.compile(r"<<opt>>|<</opt>>|<<var:\d+>>|<<|>>|\||[^\s<>|]+")
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = rb"[^0-9a-z\x80-\xff]+"


@dataclass
class Automaton:
    """States from 0 to final; steps[s] has (word or None for any, next state); free[s] has states reached without a word."""

    label: str
    weight: float
    steps: list[list[tuple[bytes | None, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    final: int = 0
    anchor: tuple[bytes, ...] = ()

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def starts(self) -> set[bytes | None]:
        return {w for s in self.closure({0}) for w, _ in self.steps[s]}

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted run of words from at, or -1."""
        now, best, k = self.closure({0}), -1, at
        while now:
            if self.final in now:
                best = k
            if k == len(words):
                break
            w = words[k]
            now = self.closure({t for s in now for word, t in self.steps[s] if word is None or word == w})
            k += 1
        return best


def compile_template(label: str, weight: float, wording: str) -> Automaton:
    """The automaton of one template; its anchor is the longest run of mandatory words, which every match holds."""
    out = Automaton(label, weight)
    tokens = _TOKEN.findall(wording.lower())
    at, runs, run = 0, [], []

    def sequence(state: int, depth: int) -> int:
        nonlocal at, run
        while at < len(tokens):
            t = tokens[at]
            if t in ("<</opt>>", ">>", "|"):
                return state
            at += 1
            if t == "<<opt>>":
                runs.append(run)
                run = []
                end = sequence(state, depth + 1)
                after = out.state()
                out.free[end].append(after)
                out.free[state].append(after)
                state, run = after, []
                at += 1
            elif t.startswith("<<var:"):
                runs.append(run)
                run = []
                after = out.state()
                for _ in range(int(t[6:-2])):
                    out.free[state].append(after)
                    step = out.state()
                    out.steps[state].append((None, step))
                    state = step
                out.free[state].append(after)
                state = after
            elif t == "<<":
                runs.append(run)
                run = []
                after = out.state()
                while True:
                    first = out.state()
                    out.free[state].append(first)
                    out.free[sequence(first, depth + 1)].append(after)
                    at += 1
                    if tokens[at - 1] == ">>":
                        break
                state, run = after, []
            else:
                step = out.state()
                out.steps[state].append((t.encode(), step))
                state = step
                if depth == 0:
                    run.append(t.encode())
        return state

    out.state()
    out.final = sequence(0, 0)
    out.anchor = tuple(max([*runs, run], key=lambda r: (len(r), sum(map(len, r)))))
    if not out.anchor:
        raise ValueError(f"a template needs a mandatory word: {wording}")
    return out


@dataclass
class Scanner:
    """All templates with one byte pattern for their anchors, which picks the texts and automata to run."""

    base: list[Automaton]
    extra: list[Automaton]

    def __post_init__(self) -> None:
        anchors = sorted({a.anchor for a in (*self.base, *self.extra)}, key=lambda a: (-len(a), a))
        word = {a: re.escape(a[0]) + b"".join(_GAP + re.escape(w) for w in a[1:]) for a in anchors}
        self.any = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(word[a] for a in anchors) + rb")(?![0-9a-z\x80-\xff])")

    def places(self, automaton: Automaton, words: list[bytes], where: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        if not all(w in where for w in automaton.anchor):
            return []
        heads = automaton.starts()
        starts = range(len(words)) if None in heads else sorted(i for w in heads for i in where.get(w, ()))
        return [(i, end) for i in starts if (end := automaton.match(words, i)) >= 0]

    def scan(self, lowered: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], float]:
        """(label, first word, end word) of base and other matches, and the score."""
        words = _WORDS.findall(lowered)
        where: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            where.setdefault(w, []).append(i)
        base, extra, missed = [], [], 1.0
        for group, found in ((self.base, base), (self.extra, extra)):
            for a in group:
                if hits := self.places(a, words, where):
                    missed *= 1 - a.weight
                    found += [(a.label, *hit) for hit in hits]
        return base, extra, 1 - missed


def compile_all(base: tuple = BASE, templates: tuple = TEMPLATES) -> Scanner:
    return Scanner([compile_template(n, BASE_WEIGHT, w) for n, w in base], [compile_template(*t) for t in templates])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, base: tuple = BASE, templates: tuple = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of words, the base places (count, smallest and largest first word), labels and a score from 0 to 1."""
    made: dict[str, Scanner] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = made.get("it") or made.setdefault("it", compile_all(base, templates))
        rows = []
        for _, _, offsets, data in slabs(batch.column(1)):
            lowered = LOWER[data]
            starts, _ = spans(lowered, offsets, ALNUM)
            counts = np.diff(np.searchsorted(starts, offsets))
            body = lowered.tobytes()
            places = offsets.tolist()
            for k, n in enumerate(counts.tolist()):
                a, b = places[k], places[k + 1]
                if not scanner.any.search(text_of := body[a:b]):
                    rows.append((n, 0, None, None, "", "", 0.0))
                    continue
                found, extra, score = scanner.scan(text_of)
                firsts = [i for _, i, _ in found]
                own = sorted({label for label, _, _ in found})
                both = sorted({*own, *(label for label, _, _ in extra)})
                rows.append((n, len(found), min(firsts, default=None), max(firsts, default=None), ",".join(own), ",".join(both), score))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return map_batches(with_text(docs, key, text), run, SCHEMA)
