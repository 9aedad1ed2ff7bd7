"""License scans by template markup.

A template is plain wording with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>`` (may be
missing, may nest) and ``<<var;name=...;words=a-b>>`` (any a to b words). It compiles to an automaton
over words; a text is accepted where some run of its words spells the mandatory wording exactly.
Words are compared by their 64-bit hashes, computed for many texts at once.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .postings import bytes_of, column
from .words import MARKS, spans, word_hashes

#: Phrases that are looked for in every text, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices in template markup, by the label they give.
TEMPLATES = {
    "gpl-notice": "<<beginOptional>>this <<var;name=what;words=1-3>> is<<endOptional>> "
    "<<beginOptional>>free software<<endOptional>> licensed under the "
    "<<beginOptional>>terms of the<<endOptional>> gnu general public license version <<var;name=version;words=1-2>> "
    "<<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    "apache-notice": "licensed under the apache license version <<var;name=version;words=1-2>> "
    "<<beginOptional>>the license<<endOptional>>",
    "cc-by-notice": "licensed under <<beginOptional>>a creative commons attribution<<endOptional>> cc by "
    "<<beginOptional>>nc<<endOptional>> <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> "
    "<<var;name=version;words=1-2>>",
    "mit-notice": "<<beginOptional>>this <<var;name=what;words=1-3>> is<<endOptional>> released under the "
    "<<beginOptional>>terms of the<<endOptional>> mit license",
}

#: Licence texts and headers in template markup: the wording that tells each apart, with its variable parts.
TEXTS = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this "
    "<<var;name=what;words=1-4>> <<beginOptional>>and associated documentation files<<endOptional>> "
    "<<beginOptional>>the software<<endOptional>> to deal in the <<var;name=what;words=1-4>> without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "redistribution and use <<beginOptional>>of this software<<endOptional>> in source and binary forms with or without "
    "modification are permitted provided that the following conditions are met <<var;name=number;words=0-1>> redistributions of "
    "source code must retain the <<beginOptional>>above<<endOptional>> copyright notice",
    "bsd-3-clause-text": "neither the name of <<var;name=owner;words=1-12>> <<beginOptional>>nor the names of its contributors<<endOptional>> "
    "may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-header": "licensed under the apache license version <<var;name=version;words=1-2>> the license you may not use this file "
    "except in compliance with the license",
    "apache-text": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide "
    "non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of",
    "gpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation",
    "lgpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
    "license as published by the free software foundation",
    "lgpl-2-header": "is free software you can redistribute it and or modify it under the terms of the gnu library general public "
    "license as published by the free software foundation",
    "agpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
    "license as published by the free software foundation",
    "gpl-text": "the licenses for most software <<beginOptional>>and other practical works<<endOptional>> are designed to take away your "
    "freedom to share and change",
    "mpl-header": "this source code form is subject to the terms of the mozilla public license v <<var;name=version;words=1-2>> if a copy "
    "of the mpl was not distributed with this file you can obtain one at",
    "mpl-1-header": "the contents of this file are subject to the mozilla public license version <<var;name=version;words=1-2>> the license "
    "you may not use this file except in compliance with the license",
    "cc-deed": "<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> "
    "<<beginOptional>>the<<endOptional>> creative commons attribution <<var;name=terms;words=0-4>> "
    "<<var;name=version;words=1-2>> <<beginOptional>>international<<endOptional>> license",
    "cc-by-text": "you are free to share copy and redistribute the material in any medium or format",
}

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")


def hashes_of(text: str) -> list[int]:
    return word_hashes([text.encode()], MARKS)[0].tolist()


@dataclass
class Automaton:
    """States 0..n; ``on[s]``: (word, next state), word None for any; ``free[s]``: states reached without a word."""

    on: list[list[tuple[int | None, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0
    #: Words that can begin a match.
    starts: set[int] = field(default_factory=set)
    #: A word that every match holds.
    must: int = 0

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def passes_without(self, word: int) -> bool:
        """A match need not hold the word."""
        todo, seen = [0], {0}
        while todo:
            s = todo.pop()
            for t in [*self.free[s], *(t for w, t in self.on[s] if w != word)]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return self.final in seen

    def accepts(self, words: list[int], at: int) -> bool:
        """A run of words that begins at ``at`` spells the template."""
        states = self.closed({0})
        for w in words[at : at + len(self.on)]:
            states = self.closed({t for s in states for word, t in self.on[s] if word is None or word == w})
            if self.final in states:
                return True
            if not states:
                return False
        return False


def compiled(template: str) -> Automaton:
    """The automaton of a template. Its first word outside markup must be mandatory or an optional one's first."""
    a = Automaton()
    here = 0
    open_at: list[int] = []
    place = 0
    for m in [*_MARKUP.finditer(template), None]:
        for w in hashes_of(template[place : m.start() if m else len(template)]):
            nxt = a.state()
            a.on[here].append((w, nxt))
            here = nxt
        if m is None:
            break
        place = m.end()
        if m[1] == "beginOptional":
            # a state of its own, so that the way around leaves from before the part
            nxt = a.state()
            a.free[here].append(nxt)
            here = nxt
            open_at.append(here)
        elif m[1] == "endOptional":
            if not open_at:
                raise ValueError("endOptional without beginOptional")
            nxt = a.state()
            a.free[here].append(nxt)
            a.free[open_at.pop()].append(nxt)
            here = nxt
        else:
            span = re.search(r"words=(\d+)-(\d+)", m[2])
            if not span:
                raise ValueError(f"no words=a-b in {m[0]}")
            ways = [here]
            for k in range(int(span[2])):
                nxt = a.state()
                a.on[here].append((None, nxt))
                here = nxt
                if k + 1 >= int(span[1]):
                    ways.append(here)
            if int(span[1]):
                ways.remove(ways[0])
            end = a.state()
            for s in ways:
                a.free[s].append(end)
            here = end
    if open_at:
        raise ValueError("beginOptional without endOptional")
    a.final = here
    if all(w is None or a.passes_without(w) for way in a.on for w, _ in way):
        raise ValueError("a template needs mandatory wording")
    firsts = {w for s in a.closed({0}) for w, _ in a.on[s]}
    if None in firsts:
        raise ValueError("a template must not begin with a replaceable part")
    a.starts = firsts
    a.must = [w for way in a.on for w, _ in way if w is not None and not a.passes_without(w)][-1]
    return a


def license_marks(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES | TEXTS) -> DataFrame:
    """Phrase places and labels per row of ``docs`` (doc_id, text).

    Null and empty texts have no words: counts of 0, null first_word and last_word, empty labels, score 0.
    Repeated rows and null ids each give a row; other columns are ignored. ``score`` is 1 where a template
    accepts, else 0.5 where a phrase stands, else 0.
    """
    base = [(hashes_of(p), label) for p, label in phrases.items()]
    automata = {label: compiled(t) for label, t in templates.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(sorted({w for a in automata.values() for w in a.starts}), np.uint64)
        musts = np.array(sorted({a.must for a in automata.values()}), np.uint64)
        for b in batches:
            texts = bytes_of(column(b, "text"))
            out = []
            for lo, hi in spans(texts):
                words, bound = word_hashes(texts[lo:hi], MARKS)
                places: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in base:
                    at = np.flatnonzero(words == np.uint64(phrase[0]))
                    for k, w in enumerate(phrase[1:], 1):
                        at = at[at + k < len(words)]
                        at = at[words[at + k] == np.uint64(w)]
                    doc = np.searchsorted(bound, at, side="right") - 1
                    inside = at + len(phrase) <= bound[doc + 1]
                    for p, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                        places.setdefault(d, []).append((p - int(bound[d]), label))
                more: dict[int, set[str]] = {}
                # only in texts that hold a word without which no template matches
                could = np.unique(np.searchsorted(bound, np.flatnonzero(np.isin(words, musts)), side="right") - 1)
                part = [np.arange(bound[d], bound[d + 1]) for d in could]
                at = np.concatenate(part) if part else np.zeros(0, np.int64)
                at = at[np.isin(words[at], starts)]
                doc = np.searchsorted(bound, at, side="right") - 1
                for p, d in zip(at.tolist(), doc.tolist(), strict=True):
                    w = int(words[p])
                    tail: list[int] | None = None
                    for label, a in automata.items():
                        if w in a.starts and label not in more.get(d, ()):
                            if tail is None:
                                tail = words[p : min(bound[d + 1], p + longest)].tolist()
                            if a.accepts(tail, 0):
                                more.setdefault(d, set()).add(label)
                for d in range(hi - lo):
                    mine = places.get(d, [])
                    labels = {x for _, x in mine}
                    every = labels | more.get(d, set())
                    where = [p for p, _ in mine]
                    out.append((
                        int(bound[d + 1] - bound[d]), len(mine), min(where, default=None), max(where, default=None),
                        ",".join(sorted(labels)), ",".join(sorted(every)), 1.0 if d in more else 0.5 if mine else 0.0,
                    ))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                [f.split()[0] for f in RESULT.split(", ")],
            )

    # no match is longer than its automaton has states
    longest = max((len(a.on) for a in automata.values()), default=0)
    return docs.select("doc_id", "text").mapInArrow(scan, RESULT)
