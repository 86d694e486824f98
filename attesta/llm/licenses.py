"""License scans: template markup compiled into token automata.

A template is words with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>`` may be left
out, and ``<<var;low-high;pattern>>`` stands for that many words, each of which matches the pattern
as a whole (``<<var;n>>``: at most ``n`` words of any kind).  It is compiled into an automaton over
word tokens, and a text is accepted at every place where the mandatory wording stands exactly.  Only
tokens count: letters' case (A-Z), punctuation, typographic quotes, dashes and bullets, and spacing do
not.

Automata run from the places of a template's first mandatory word that begins an occurrence of its
anchor, a short run of mandatory words, so most of a text is passed over by one substring search.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

# Base phrases and their labels, fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# License wording, fixed values; markup as described above.
TEMPLATES = (
    ("gpl", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu <<beginOptional>>lesser<<endOptional>> general public license <<beginOptional>>version <<var;2>><<endOptional>>"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license <<beginOptional>>version 2 0<<endOptional>>"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at <<var;8>> unless required by applicable law"),
    ("cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution <<var;4>> license"),
    ("cc-by-nc", "cc by nc <<beginOptional>>4 0<<endOptional>>"),
    ("cc-by-sa", "cc by sa <<beginOptional>>4 0<<endOptional>>"),
    ("mit", "released under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

# Whole licenses and notices, fixed values; their labels end in ``:text`` or ``:notice``.
_BSD_CONDITIONS = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<var;0-1;1|a>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<var;0-1;2|b>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution
"""
_BSD_NAMES = """
<<var;0-1;3|c>> neither the <<var;1-1;names?>> of <<var;1-12>> nor the names of <<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote
products derived from this software without specific prior written permission
"""
_BSD_DISCLAIMER = """
this software is provided by <<var;1-10>> as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;1-12>> be liable for any direct indirect incidental
special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits
or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of such damage
"""
_ISC_GRANT = "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """
the software is provided as is and <<var;1-6>> disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall <<var;1-6>> be liable for any special direct indirect or consequential damages or any damages
whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in
connection with the use or performance of this software
"""
WHOLE = (
    ("mit:text", """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
<<var;1-2;sublicense|sub|license>> and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall
be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied
including but not limited to the warranties of merchantability fitness for a particular purpose and <<var;1-2;noninfringement|non|infringement>>
in no event shall the <<beginOptional>>authors or<<endOptional>> copyright holders <<beginOptional>>or contributors<<endOptional>> be liable for any
claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
the use or other dealings in the software"""),
    ("bsd-2-clause:text", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3-clause:text", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("isc:text", _ISC_GRANT + " provided that the above copyright notice and this permission notice appear in all copies " + _ISC_DISCLAIMER),
    ("0bsd:text", _ISC_GRANT + _ISC_DISCLAIMER),
    ("zlib:text", """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
alter it and redistribute it freely subject to the following restrictions <<var;0-1;1>> the origin of this software must not be misrepresented
you must not claim that you wrote the original software if you use this software in a product an <<var;1-1;acknowledge?ment>> in the product
documentation would be appreciated but is not required <<var;0-1;2>> altered source versions must be plainly marked as such and must not be
misrepresented as being the original software <<var;0-1;3>> this notice may not be removed or altered from any source distribution"""),
    ("apache-2.0:notice", """
licensed under the apache license version 2 0 the license you may not use this <<var;1-1;file|work>> except in compliance with the license you
may obtain a copy of the license at <<var;1-9;https?|www|apache|org|licenses|license|2|0>> unless required by applicable law or agreed to in
writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
implied see the license for the specific language governing permissions and limitations under the license"""),
    ("gpl:notice", """
is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>><<var;1-1;lesser|library|affero>><<endOptional>>
general public license as published by the free software foundation either version <<var;1-2;\\d+>> of the license or at your option any later
version <<var;1-4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
merchantability or fitness for a particular purpose see the gnu <<beginOptional>><<var;1-1;lesser|library|affero>><<endOptional>> general public
license for more details"""),
)

_TO_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else (c + 32 if 0x41 <= c <= 0x5A else 0x20) for c in range(256))
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;(?:(\d+)-)?(\d+)(?:;(.*?))?)>>", re.DOTALL)
_SIGNS = re.compile("[\u2010-\u2015\u2018-\u201f\u2022\u00a0\u00a9\u00ab\u00bb\u00b7]")


def normal(text: bytes) -> bytes:
    """The words of a text with one space before and after each."""
    return b" " + b" ".join(text.translate(_TO_SPACE).split()) + b" "


def unsigned(said: bytes) -> bytes:
    """The same words where typographic quotes, dashes and bullets part words as those of ASCII do."""
    return said if said.isascii() else normal(_SIGNS.sub(" ", said.decode("utf-8", "replace")).encode())


@dataclass(frozen=True)
class Automaton:
    """Token steps: ("word", w), ("any", (low, high, pattern)) and jumps over optional regions as ("maybe", target)."""

    label: str
    steps: tuple
    anchor: bytes

    def accepts(self, tokens: list[bytes], start: int) -> int | None:
        """The largest end of an accepted run of ``tokens`` from ``start``, or None."""
        states, best, at = self._closed({(0, 0)}), None, start
        while states:
            if any(i == len(self.steps) for i, _ in states):
                best = at
            if at >= len(tokens):
                break
            token, moved = tokens[at], set()
            for i, used in states:
                if i == len(self.steps):
                    continue
                kind, arg = self.steps[i]
                if kind == "word" and token == arg:
                    moved.add((i + 1, 0))
                elif kind == "any" and used < arg[1] and (arg[2] is None or arg[2].fullmatch(token)):
                    moved.add((i, used + 1))
            states, at = self._closed(moved), at + 1
        return best

    def _closed(self, states: set) -> set:
        todo = list(states)
        while todo:
            i, used = todo.pop()
            if i < len(self.steps):
                kind, arg = self.steps[i]
                more = [(i + 1, 0), (arg, 0)] if kind == "maybe" else [(i + 1, 0)] if kind == "any" and used >= arg[0] else []
                for s in more:
                    if s not in states:
                        states.add(s)
                        todo.append(s)
        return states


def compile_template(label: str, markup: str) -> Automaton:
    """An automaton of a template; the anchor is its first run of mandatory words, at most four."""
    steps: list = []
    opened: list[int] = []
    at = 0
    plain: list[bytes] = []
    started = done = False
    for m in [*_MARKUP.finditer(markup), None]:
        for w in normal(markup[at : m.start() if m else len(markup)].encode()).split():
            steps.append(("word", w))
            if not opened and not done and len(plain) < 4:
                plain.append(w)
                started = True
        if m is None:
            break
        at = m.end()
        done = done or started
        if m[1] == "beginOptional":
            opened.append(len(steps))
            steps.append(None)
        elif m[1] == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            steps[opened.pop()] = ("maybe", len(steps))
        else:
            low, high = int(m[2] or 0), int(m[3])
            if low > high:
                raise ValueError("a replaceable region of no length")
            steps.append(("any", (low, high, re.compile(m[4].encode()) if m[4] else None)))
    if opened or not plain:
        raise ValueError("a template needs closed regions and a mandatory word")
    first = next(i for i, s in enumerate(steps) if s == ("word", plain[0]))
    if first:
        raise ValueError("a template starts with mandatory wording")
    return Automaton(label, tuple(steps), b" " + b" ".join(plain) + b" ")


def _places(text: bytes, phrase: bytes) -> list[int]:
    found, at = [], text.find(phrase)
    while at >= 0:
        found.append(at)
        at = text.find(phrase, at + 1)
    return found


def _ordinals(said: bytes, places: list[int]) -> list[int]:
    """The ordinals of the words that begin at ``places``."""
    gaps = np.flatnonzero(np.frombuffer(said, dtype=np.uint8) == 0x20)
    return np.searchsorted(gaps, places).tolist() if places else []


def scan_text(text: bytes, phrases, automata) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score) of one text."""
    said = normal(text)
    n_words = said.count(b" ") - 1 if len(said) > 2 else 0
    if not n_words:
        return 0, 0, None, None, "", "", 0.0
    hits = [(p, label) for phrase, label in phrases for p in _places(said, phrase)]
    worded = unsigned(said)
    found = [(p, a) for a in automata for p in _places(worded, a.anchor)]
    if not hits and not found:
        return n_words, 0, None, None, "", "", 0.0
    starts = _ordinals(said, [p for p, _ in hits])
    base = {label for _, label in hits}
    accepted = set()
    if found:
        tokens = worded.split()
        for start, (_, a) in zip(_ordinals(worded, [p for p, _ in found]), found, strict=True):
            if a.label not in accepted and a.accepts(tokens, start) is not None:
                accepted.add(a.label)
    score = 1.0 if accepted else 0.5
    return n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | accepted)), score if base or accepted else 0.0


def scan(documents: DataFrame, phrases=PHRASES, templates=TEMPLATES + WHOLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places where a base phrase's words stand in a row, ``first_word`` and
    ``last_word`` are the smallest and largest start (null without any).  ``labels`` adds those of
    accepted templates.  The score is 1 where a template is accepted, 0.5 where only a base phrase
    stands, else 0.  Null texts count as empty; a null id stays null; repeated rows keep a row each;
    an empty table gives an empty result; other columns are ignored.  Texts are read whole; an
    automaton reads no further from a place than its own longest wording.
    """
    automata = [compile_template(*t) for t in templates]
    spaced = [(normal(p.encode()), label) for p, label in phrases]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for batch in batches:
            rows = [scan_text(t, spaced, automata) for t in utf8(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
