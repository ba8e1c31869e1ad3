"""License scans by template-markup matching (operator 7).

A template is a line of wording with two kinds of regions::

    [[ words ]]        optional words
    {{ least most }}   any words, from ``least`` to ``most`` of them (replaceable)

It compiles to an automaton over words. A text is accepted at a place if all mandatory
words stand there, in order, each optional region whole or absent, each replaceable one
within its bounds. Only places of a template's first word are tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytespans import lower_ascii, runs, text_slices
from .shared import id_and_text

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Wording of public licenses and of their notices, with regions marked up, and their labels.
_AS_IS = "the software is provided as is"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_END = (
    "this software is provided by {{1 12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{1 12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
TEMPLATES = [
    ("licensed under the apache license version 2 [[0]]", "Apache-2.0-notice"),
    ("licensed under [[the]] [[terms of the]] mit license", "MIT-notice"),
    ("licensed under [[a]] [[creative commons]] cc by nc [[{{0 1}}]] 4 0", "CC-BY-NC-4.0-notice"),
    ("licensed under [[a]] [[creative commons]] cc by 4 0", "CC-BY-4.0-notice"),
    ("licensed under [[a]] [[creative commons]] cc by sa 4 0", "CC-BY-SA-4.0-notice"),
    ("licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version {{1 1}}", "GPL-notice"),
    ("licensed under [[the terms of]] the gnu lesser general public license [[as published by the free software foundation]] [[either]] version {{1 1}}", "LGPL-notice"),
    ("licensed under [[the terms of]] the gnu affero general public license [[as published by the free software foundation]] [[either]] version {{1 1}}", "AGPL-notice"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        f"{_AS_IS} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {{1 12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "MIT",
    ),
    (
        "permission to use copy modify [[and or]] [[and]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        f"{_AS_IS} and {{{{1 12}}}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {{1 12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "ISC",
    ),
    (_BSD + _BSD_END, "BSD-2-Clause"),
    (_BSD + "[[3]] neither the name of {{1 12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END, "BSD-3-Clause"),
    ("copyright [[c]] {{0 12}} all rights reserved", "all-rights-reserved"),
]
_WORD_BYTES = np.ones(256, dtype=bool)
_WORD_BYTES[:0x80] = False
_WORD_BYTES[48:58] = _WORD_BYTES[97:123] = True
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\s*(\d+)\s+(\d+)\s*\}\}|[^\s\[\]{}]+")


class Template:
    """A token automaton: ``moves[state]`` is ``(word or None for any, next state)``, ``skips[state]`` moves without a word."""

    def __init__(self, markup: str):
        self.moves: list[list[tuple[str | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        open_: list[int] = []
        for found in _MARKUP.finditer(markup):
            token, now = found[0], len(self.moves) - 1
            if token == "[[":
                open_.append(now)
            elif token == "]]":
                self.skips[open_.pop()].append(now)
            elif found[1] is not None:
                least, most = int(found[1]), int(found[2])
                for k in range(most):
                    self._state(None)
                for k in range(least, most):
                    self.skips[now + k].append(len(self.moves) - 1)
            else:
                self._state(token)
        if open_:
            raise ValueError(f"an optional region is not closed: {markup}")
        self.last = len(self.moves) - 1
        self.first = {word for s in self._reach({0}) for word, _ in self.moves[s]}
        if None in self.first or self.last in self._reach({0}):
            raise ValueError(f"a template must start with a word: {markup}")

    def _state(self, word: str | None) -> None:
        self.moves[-1].append((word, len(self.moves)))
        self.moves.append([])
        self.skips.append([])

    def _reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepts(self, words: Iterable[str]) -> int:
        """How many of ``words``, from the first on, the wording takes; 0 if it doesn't stand there."""
        states = self._reach({0})
        for k, word in enumerate(words):
            states = self._reach({n for s in states for w, n in self.moves[s] if w is None or w == word})
            if self.last in states:
                return k + 1
            if not states:
                return 0
        return 0


def _places(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Numbers, in order, of the runs that are one of ``words``; runs end with their row, whatever byte follows."""
    out = [np.zeros(0, dtype=np.int64)]
    for word in words:
        at = np.flatnonzero(ends - starts == len(word))
        for k, byte in enumerate(word):
            at = at[body[starts[at] + k] == byte]
        out.append(at)
    return np.sort(np.concatenate(out))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, hits array<struct<start, label, base, words>>`` for every row of ``docs``.

    Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased;
    ``start`` counts words from 0. ``base`` hits are places of ``phrases``, others of
    ``templates``; ``words``: how many words were taken. A null text counts as empty. Repeated rows and null ids stay; an empty
    table gives an empty table; other columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("words", pa.int64())]))
    wanted = [(phrase.split(), label) for phrase, label in phrases.items()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [(Template(markup), label) for markup, label in templates]
        reach = max([len(words) for words, _ in wanted] + [len(m.moves) for m, _ in machines])
        openers = [w.encode() for w in sorted({words[0] for words, _ in wanted}.union(*(m.first for m, _ in machines)))]
        for batch in batches:
            counts, hits = [], []
            for first, last, buf, off in text_slices(batch.column(1)):
                lower_ascii(buf)
                body = buf[: off[-1]]
                starts, ends = runs(_WORD_BYTES[body], off)
                bounds = np.searchsorted(starts, off)
                counts += (bounds[1:] - bounds[:-1]).tolist()
                raw = body.tobytes()
                found: list[list] = [[] for _ in range(last - first)]
                places = _places(body, starts, ends, openers)
                rows = np.searchsorted(bounds, places, side="right") - 1
                for place, row in zip(places.tolist(), rows.tolist(), strict=True):
                    stop = min(place + reach, int(bounds[row + 1]))
                    first_word = raw[starts[place] : ends[place]].decode()
                    words = lambda k=place, end=stop: (raw[starts[i] : ends[i]].decode() for i in range(k, end))
                    labels = [(label, True, len(phrase)) for phrase, label in wanted if first_word == phrase[0] and list(islice(words(), len(phrase))) == phrase]
                    labels += [(label, False, n) for m, label in machines if first_word in m.first and (n := m.accepts(words()))]
                    found[row] += [{"start": place - int(bounds[row]), "label": label, "base": base, "words": n} for label, base, n in labels]
                hits += found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, kind)], ["doc_id", "n_words", "hits"])

    return id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, n_words long, hits array<struct<start: long, label: string, base: boolean, words: long>>")


def license_labels(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of ``scan_licenses``'s rows.

    ``score``: n / (n + 2) for the longest wording of n words that a template accepts, at
    least n / (n + 4) for a base phrase, 0 without either.
    """
    base, every = F.filter("hits", lambda h: h["base"]), F.col("hits")
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    places = F.transform(base, lambda h: h["start"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), names(base).alias("base_labels"), names(every).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["words"] / (h["words"] + F.when(h["base"], 4).otherwise(2)))), F.lit(0.0)).alias("score"),
    )
