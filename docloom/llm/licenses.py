"""License scans: licence wordings with optional and replaceable regions, compiled into automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .byte_tokens import buffers, group, slices
from .common import ASCII_LOWER, read

#: Bytes of a word: digits, letters, and all bytes of characters beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: States that an automaton remembers before it starts anew.
MOST_STATES = 100_000
NAME, TEXT = "name", "text"

# The names of licences, by label.
NAMES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

# Wordings of licences, by label. [[ ]] may be left out, {{2..5}} stands for two to five words of any kind, {{a|b}} for
# one of the wordings a and b; all else is mandatory. Case and what stands between words say nothing.
WARRANTY = (
    "{{this software|the software}} is provided {{by the copyright holders and contributors|by the authors and contributors|by the regents and contributors|by {{1..12}}}} as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
    "{{1..12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
    "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "[[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "[[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
GRANT = "{{licensed|released|available|distributed|published|provided}} under "
THE_GPL = "the [[terms of the]] GNU {{General Public License|GPL}} "
BY_VERSION = "as published by the Free Software Foundation, either version "
OR_LATER = " of the License, or (at your option) any later version"
FREE_TO = "is free software: you can redistribute it and/or modify it under the terms of the GNU "
CC = "{{CC|Creative Commons}} "
CC_END = " [[International|Unported|Generic]] [[{{License|Licence}}]]"
TEXTS = {
    "mit": (
        GRANT + "[[the terms of]] the MIT {{license|licence}}",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the \"Software\")]], to "
        "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. "
        "[[THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{1..12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE]]",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
    "bsd-2-clause": (BSD + WARRANTY,),
    "bsd-3-clause": (
        BSD + "[[3]] Neither the name of {{1..12}} nor the names of [[its|his|her|their]] contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission [[" + WARRANTY + "]]",
    ),
    "apache-2.0": (
        GRANT + "the Apache License, Version 2.0 [[(the \"License\")[[;]] you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "[[http|https]] www.apache.org/licenses/LICENSE-2.0]]",
    ),
    "gpl-2.0": (GRANT + THE_GPL + "{{version 2|v2}} [[only]]",),
    "gpl-2.0-or-later": ("[[{{this|the}} {{program|software|library|file}}]] " + FREE_TO + "General Public License " + BY_VERSION + "2" + OR_LATER, GRANT + THE_GPL + "{{version 2|v2}} or [[(at your option)]] any later version"),
    "gpl-3.0": (GRANT + THE_GPL + "{{version 3|v3}} [[only]]",),
    "gpl-3.0-or-later": ("[[{{this|the}} {{program|software|library|file}}]] " + FREE_TO + "General Public License " + BY_VERSION + "3" + OR_LATER, GRANT + THE_GPL + "{{version 3|v3}} or [[(at your option)]] any later version"),
    "lgpl-2.1-or-later": ("[[{{this|the}} {{program|software|library|file}}]] " + FREE_TO + "Lesser General Public License " + BY_VERSION + "2.1" + OR_LATER,),
    "agpl-3.0-or-later": ("[[{{this|the}} {{program|software|library|file}}]] " + FREE_TO + "Affero General Public License " + BY_VERSION + "3" + OR_LATER,),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. [[If a copy of the MPL was not distributed with this file, You can obtain one at [[http|https]] mozilla.org/MPL/2.0]]",),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will {{1..12}} be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain. [[Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software]]",),
    "cc0-1.0": (CC + "{{Zero|CC0}} [[v]] 1.0 [[Universal]] [[Public Domain Dedication]]", "CC0 1.0 [[Universal]] [[Public Domain Dedication]]"),
    "cc-by-4.0": (CC + "{{BY|Attribution}} 4.0" + CC_END,),
    "cc-by-sa-4.0": (CC + "{{BY|Attribution}} {{SA|ShareAlike|Share Alike}} 4.0" + CC_END,),
    "cc-by-nc-4.0": (CC + "{{BY|Attribution}} {{NC|NonCommercial|Non Commercial}} 4.0" + CC_END,),
    "cc-by-nd-4.0": (CC + "{{BY|Attribution}} {{ND|NoDerivatives|No Derivatives}} 4.0" + CC_END,),
    "cc-by-nc-sa-4.0": (CC + "{{BY|Attribution}} {{NC|NonCommercial|Non Commercial}} {{SA|ShareAlike|Share Alike}} 4.0" + CC_END,),
    "cc-by-nc-nd-4.0": (CC + "{{BY|Attribution}} {{NC|NonCommercial|Non Commercial}} {{ND|NoDerivatives|No Derivatives}} 4.0" + CC_END,),
}


def parse(markup: str) -> tuple:
    """The tree of a template: ("all", parts), ("any", choices), ("word", w) or ("gap", least, most)."""
    pieces = re.findall(r"\[\[|\]\]|\{\{|\}\}|\||(?:(?!\[\[|\]\]|\{\{|\}\})[^|])+", markup)
    at = 0

    def sequence(until: tuple[str, ...]) -> tuple:
        nonlocal at
        parts: list[tuple] = []
        while at < len(pieces) and pieces[at] not in until:
            piece = pieces[at]
            at += 1
            if piece == "[[":
                parts.append(("any", (*choices("]]"), ("all", ()))))
            elif piece == "{{":
                gap = re.fullmatch(r"\s*(\d+)\.\.(\d+)\s*", pieces[at]) if at < len(pieces) else None
                if gap:
                    at += 1
                parts.append(("any", choices("}}", gap)))
            elif piece in ("]]", "}}"):
                raise ValueError(f"{piece} without its beginning: {markup[:80]}")
            else:
                parts += [("word", w) for w in WORDS.findall(piece.translate(ASCII_LOWER))]
        return "all", tuple(parts)

    def choices(end: str, gap: re.Match | None = None) -> tuple:
        nonlocal at
        found = [("gap", int(gap[1]), int(gap[2]))] if gap else [sequence((end, "|"))]
        while at < len(pieces) and pieces[at] == "|":
            at += 1
            found.append(sequence((end, "|")))
        if at == len(pieces) or pieces[at] != end:
            raise ValueError(f"no {end}: {markup[:80]}")
        at += 1
        return tuple(found)

    tree = sequence(("|",))
    if at < len(pieces):
        raise ValueError(f"| outside of a region: {markup[:80]}")
    return tree


class Automaton:
    """All templates in one automaton over words, begun at any word and made deterministic as texts need it."""

    def __init__(self, names: dict[str, str], texts: dict[str, tuple[str, ...]]):
        self.vocab: dict[bytes, int] = {}
        self.arcs: list[dict[int, list[int]]] = []
        self.gaps: list[list[int]] = []
        self.free: list[list[int]] = []
        self.ends: dict[int, int] = {}
        self.labels: list[tuple[str, str]] = []
        begin = self._state()
        for kind, label, markup in [(NAME, k, v) for k, v in names.items()] + [(TEXT, k, v) for k, vs in texts.items() for v in vs]:
            end = self._build(parse(markup), begin)
            self.ends[end] = len(self.labels)
            self.labels.append((kind, label))
        first = self._closure({begin})
        if any(s in self.ends for s in first) or any(self.gaps[s] for s in first):
            raise ValueError("a template must begin with a word")
        self.begin = first
        self.first = np.zeros(len(self.vocab) + 1, bool)
        self.first[[w for s in first for w in self.arcs[s]]] = True
        self._forget()

    def _state(self) -> int:
        self.arcs.append({})
        self.gaps.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _build(self, node: tuple, begin: int) -> int:
        """Adds what ``node`` accepts from state ``begin`` on; the state at its end."""
        kind = node[0]
        if kind == "all":
            at = self._state()
            self.free[begin].append(at)
            for part in node[1]:
                at = self._build(part, at)
            return at
        end = self._state()
        if kind == "word":
            self.arcs[begin].setdefault(self.vocab.setdefault(node[1].encode(), len(self.vocab) + 1), []).append(end)
        elif kind == "gap":
            at = begin
            for i in range(node[2]):
                if i >= node[1]:
                    self.free[at].append(end)
                after = self._state()
                self.gaps[at].append(after)
                at = after
            self.free[at].append(end)
        else:
            for choice in node[1]:
                self.free[self._build(choice, begin)].append(end)
        return end

    def _closure(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def _forget(self) -> None:
        self.numbers = {frozenset(): 0, self.begin: 1}
        self.sets = [frozenset(), self.begin]
        self.accepts: list[tuple[int, ...]] = [(), ()]
        self.table: list[dict[int, int]] = [{}, {}]

    def _move(self, state: int, word: int) -> int:
        went = self._closure({t for s in self.sets[state] for t in (*self.arcs[s].get(word, ()), *self.gaps[s])})
        number = self.numbers.setdefault(went, len(self.sets))
        if number == len(self.sets):
            self.sets.append(went)
            self.table.append({})
            self.accepts.append(tuple(sorted({self.ends[s] for s in went if s in self.ends})))
        self.table[state][word] = number
        return number

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, start, end) of every place where a template is accepted, with the farthest end of each start. ``words``: numbers
        in the vocabulary, 0 for others. A text costs at most its length times the longest template."""
        out: list[tuple[int, int, int]] = []
        if len(self.sets) > MOST_STATES:
            self._forget()
        text = words.tolist()
        for start in np.flatnonzero(self.first[words]).tolist():
            state, at, best = 1, start, {}
            while at < len(text):
                word = text[at]
                after = self.table[state].get(word)
                if after is None:
                    after = self._move(state, word)
                if not after:
                    break
                state = after
                at += 1
                for t in self.accepts[state]:
                    best[t] = at
            out += [(t, start, end) for t, end in best.items()]
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: dict[str, str] = NAMES, texts: dict[str, tuple[str, ...]] = TEXTS) -> DataFrame:
    """(id_col, n_words, found) of each row: ``found`` holds every place (kind, label, start, end) by start, end in words.

    A word is a run of digits, letters or characters beyond ASCII, A-Z lower-cased. ``names`` are found wherever their words
    stand one after the other (kind ``name``), ``texts`` where a wording's mandatory words do, with any of its optional regions and
    any filling of its replaceable ones (kind ``text``); of one start the longest counts. Places may overlap.

    Nothing is shuffled: each row is scanned by itself, its words numbered by table look-ups in its text buffer. A null or empty text
    has no words; rows that repeat stay; a null id stays null; other columns are dropped; no rows give none. A text must fit a task.
    """
    more = StructType.fromDDL("n_words long, found array<struct<kind:string,label:string,start:long,end:long>>")
    schema = StructType([*docs.select(F.col(f"`{id_col}`").alias("id")).schema, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(names, texts)
        for batch in batches:
            counts, found = [], []
            for _, buf, offsets in buffers(batch.column(1)):
                starts, ends, rows = slices(buf, offsets, IS_WORD)
                codes, distinct = group(buf, starts, ends)
                number = np.fromiter((automaton.vocab.get(w, 0) for w in distinct), np.int64, len(distinct))
                words = number[codes]
                edges = np.searchsorted(rows, np.arange(len(offsets)))
                some = np.concatenate([[0], np.cumsum(automaton.first[words])])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    counts.append(b - a)
                    places = automaton.matches(words[a:b]) if some[b] > some[a] else []
                    kinds = (dict(zip(("kind", "label"), automaton.labels[t], strict=True)) | {"start": s, "end": e} for t, s, e in places)
                    found.append(sorted(kinds, key=lambda x: (x["start"], x["end"], x["kind"], x["label"])))
            place = pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place))], names=["id", "n_words", "found"])

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score: 0 without a label, a half where a licence is only named, else 1: its mandatory wording stands in the text."""
    named, worded = F.filter("found", lambda x: x["kind"] == NAME), F.filter("found", lambda x: x["kind"] == TEXT)
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        F.size(named).cast("long").alias("n_base"),
        F.array_min(F.transform(named, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(named, lambda x: x["start"])).alias("last_word"),
        _labels(named).alias("base_labels"),
        _labels(F.col("found")).alias("labels"),
        F.when(F.size(worded) > 0, 1.0).when(F.size(named) > 0, 0.5).otherwise(0.0).alias("score"),
    )
