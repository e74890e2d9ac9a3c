"""License scan: matching statistics against a generalised suffix automaton of licence words, long matches chained into spans.

The automaton holds every run of words of the licence templates. A text's words are streamed through it; at each word it knows the
longest run ending there that some template has. Runs that cannot grow further and have ``LEAST_MATCH`` words or more are
matches. For each template the best chain of matches in template order, with gaps of ``MOST_GAP`` words at most on both sides, is
worked out for every match as its last one; of the chains that cover ``LEAST_COVER`` of the template those that cover most are spans
with its label, none of them overlapping another of that template. Only stretches where ``LEAST_MATCH`` consecutive words are licence words
can hold a match, so the rest of a text is skipped at the speed of a table lookup.

Base phrases are short names of licences, found wherever their words stand together; their labels always count. Null and empty
texts have no words, score 0 and empty labels. Very long texts are scanned whole, in time that grows with their words and matches. Rows map
one to one; repeated rows and null ids stay, other columns are kept, one named ``out`` is replaced.
"""

from __future__ import annotations

from bisect import bisect
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import table, text_function, word_bytes

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: fixed values: opening and notice texts of licences as their authors ask for them to be quoted, then paragraphs of licence bodies
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mit", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
            "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
            "the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
            "this software without specific prior written permission"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
            "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
               "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
               "governing permissions and limitations under the License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
                  "compiled binary, for any purpose, commercial or non-commercial, and by any means"),
)
LEAST_MATCH, MOST_GAP, LEAST_COVER = 4, 4, 0.8
RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,start:int,end:int,cover:double>>")


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; ``ends`` lists where (template, last word) each state's runs end."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [set()]
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _add(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        copy = self._add(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._add(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def statistics(self, words: list[bytes]):
        """For every word the length of the longest run that ends there, and its state."""
        state, size = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                state, size = 0, 0
            yield size, state


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [label for label, _ in templates]
        self.words = [word_bytes(text.encode()) for _, text in templates]
        self.automaton = SuffixAutomaton(self.words)
        self.vocabulary = {w for words in self.words for w in words}
        self.base = [(b" " + b" ".join(word_bytes(p.encode())) + b" ", label) for p, label in base.items()]
        self.base_words = [max(word_bytes(p.encode()), key=len) for p in base]

    def base_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(word number, label) of every place of a base phrase."""
        line = b" " + b" ".join(words) + b" "
        found = []
        for phrase, label in self.base:
            at, counted, number = line.find(phrase), 0, 0
            while at >= 0:
                number += line.count(b" ", counted, at)
                counted = at
                found.append((number, label))
                at = line.find(phrase, at + 1)
        return found

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, start in the text, start in the template, words) of every longest match."""
        inside = np.fromiter(map(self.vocabulary.__contains__, words), bool, len(words))
        if not inside.any():
            return []
        change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        found = []
        for begin, end in zip(change[::2].tolist(), change[1::2].tolist()):
            if end - begin < LEAST_MATCH:
                continue
            stats = list(self.automaton.statistics(words[begin:end]))
            for k, (size, state) in enumerate(stats):
                if size >= LEAST_MATCH and (k + 1 == len(stats) or stats[k + 1][0] <= size):
                    found += [(t, begin + k + 1 - size, place + 1 - size, size) for t, place in self.automaton.ends[state]]
        return found

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template) of every chain that covers enough of its template."""
        by_template: dict[int, list] = {}
        for t, start, place, size in sorted(set(self.matches(words))):
            by_template.setdefault(t, []).append((start, place, size))
        found = []
        for t, matches in by_template.items():
            covered = self._chains(matches)
            taken: list[tuple[int, int]] = []  # disjoint, in order
            for share, first, end in sorted(((c, f, e) for c, f, e in covered if c >= LEAST_COVER * len(self.words[t])), key=lambda c: (-c[0], c[1:])):
                at = bisect(taken, (first, end))
                if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (first, end))
                    found.append((self.labels[t], first, end, share / len(self.words[t])))
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))

    @staticmethod
    def _chains(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(words covered, first word, end) of the best chain that ends with each match; ``matches`` come by start."""
        ending: dict[int, dict[int, tuple[int, int]]] = {}  # end in the text -> end in the template -> words covered, first word
        chains = []
        for start, place, size in matches:
            earlier = [ending[e][p] for e in range(start - MOST_GAP, start + 1) if e in ending
                       for p in range(place - MOST_GAP, place + 1) if p in ending[e]]
            best = max(earlier, key=lambda c: (c[0], c[1]), default=(0, start))
            covered, first = best[0] + size, best[1]
            here = ending.setdefault(start + size, {})
            here[place + size] = max(here.get(place + size, (0, 0)), (covered, first))
            chains.append((covered, first, start + size))
        return chains

    def scan(self, text: bytes) -> tuple:
        words = word_bytes(text)
        # a phrase can only stand where its longest word is part of the text
        low = text.lower()
        base = self.base_places(words) if any(w in low for w in self.base_words) else []
        spans = self.spans(words)
        labels = {label for _, label in base}
        score = max([0.5 + 0.5 * c for _, _, _, c in spans] + [0.5 * bool(base)], default=0.0)
        places = [p for p, _ in base]
        return (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
                ",".join(sorted(labels | {s[0] for s in spans})), min(1.0, score),
                [{"label": a, "start": b, "end": c, "cover": d} for a, b, c, d in spans])


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def scan(df: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """Add ``out``: struct of counts, labels, score and the spans covered by templates."""
    return df.withColumn(out, text_function(lambda t, s: s.scan(t), RESULT, lambda: _scanner())(F.col(text)))


@query("op1_licenses")
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")
    shown = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.withColumn("spans", shown)
