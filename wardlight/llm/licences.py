"""License scans with a positional index of rare words.

A template is a sequence of words with a mandatory key phrase.  Corpus document frequencies tell how rare the key phrases'
words are, and the index holds the postings (template, place) of the two rarest words of each key phrase.  A file's
words that the index has are its licence words of highest rarity: as a key phrase is mandatory, a file without both of
a template's two has no place for it.  Each of them is looked up, its postings turn its positions into places where a key
phrase would start, the places that both words of a template give are intersected, and there the key phrase is verified
word by word.  A place's score is the share of the whole template's words that stand in place around it.

The index reaches the scan as constant arrays, of the size of the templates: neither the plan nor the work for a file
without licence words grows with their number.

Cases.  Null and empty texts have no word, no place and score 0.  Rows are judged one by one, so repeated rows and
other columns don't matter.  Equal frequencies go to the word that comes first.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, ascii_words


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_at: int
    key_size: int
    base: bool = False

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.key_at : self.key_at + self.key_size]


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, text.translate(str.maketrans(UPPER, UPPER.lower()))))


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    words, own = words_of(text), words_of(key or text)
    at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
    return Template(label, words, at, len(own), base)


#: Texts and notices of public licences.  Fixed values.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software"""

TEMPLATES = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
    template("mit", MIT, "to any person obtaining a copy of this software and associated documentation files"),
    template("apache-2", APACHE, "licensed under the apache license version 2 0"),
    template("apache-2", "licensed under the apache license 2 0", "apache license 2 0"),
    template("bsd-2", BSD_2, "redistribution and use in source and binary forms"),
    template("bsd-3", BSD_3, "may be used to endorse or promote products derived from this software"),
    template("isc", ISC, "software for any purpose with or without fee is hereby granted"),
    template("gpl", GPL, "gnu general public license as published by the free software foundation"),
    template("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    template("lgpl", LGPL, "gnu lesser general public license as published by the free software foundation"),
    template("lgpl", "gnu lesser general public license"),
    template("mpl-2", MPL, "mozilla public license v 2 0"),
    template("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
    template("unlicense", UNLICENSE, "free and unencumbered software released into the public domain"),
    template("zlib", ZLIB, "this software is provided as is without any express or implied warranty"),
    template("bsl-1", BOOST, "to any person or organization obtaining a copy of the software"),
    template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    template("cc-by-nc", "creative commons attribution noncommercial"),
    template("cc-by-sa", "creative commons attribution sharealike"),
    template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    template("proprietary", "all rights reserved"),
)
#: Share of a template's words that must be in place around its key phrase.
LEAST = 0.5


def frequencies(words: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many rows of ``words`` (column words) each of the wanted words is; as many numbers as templates have words."""
    own = F.explode_outer(F.array_distinct(F.filter("words", lambda w: w.isin(wanted))))
    found = words.select(own.alias("w")).where("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r.w: r.n for r in found.collect()}


def anchors(t: Template, count: dict[str, int], n: int = 2) -> list[str]:
    """The rarest words of a key phrase."""
    own = list(dict.fromkeys(t.key))
    return sorted(own, key=lambda w: (count.get(w, 0), own.index(w)))[:n]


def _constant(values) -> Column:
    """An array that the optimizer folds to one constant; words or numbers."""
    values = list(values)
    whole = F.split(F.lit(" ".join(map(str, values))), " ")
    return whole if isinstance(values[0], str) else whole.cast("array<int>")


class Index:
    """Postings of the templates' anchors, and the templates, as constant arrays."""

    def __init__(self, templates: tuple[Template, ...], count: dict[str, int]):
        lists: dict[str, list[tuple[int, int, int]]] = {}
        for k, t in enumerate(templates):
            own = anchors(t, count)
            for nth, w in enumerate(own if len(own) > 1 else own * 2):
                lists.setdefault(w, []).append((k, t.key.index(w), nth))
        self.words = sorted(lists)
        flat = [p for w in self.words for p in lists[w]]
        ends = [0]
        for w in self.words:
            ends.append(ends[-1] + len(lists[w]))
        self.place_of = _constant(self.words)
        self.ends, self.template, self.at, self.nth = _constant(ends), *(_constant(p[k] for p in flat) for k in range(3))
        starts = [0]
        for t in templates:
            starts.append(starts[-1] + len(t.words))
        self.text, self.start = _constant(w for t in templates for w in t.words), _constant(starts)
        self.size, self.key_at, self.key_size = (_constant(f(t) for t in templates) for f in (lambda t: len(t.words), lambda t: t.key_at, lambda t: t.key_size))
        self.base, self.label = _constant(int(t.base) for t in templates), _constant(t.label for t in templates)

    def hits(self, words: Column) -> Column:
        """(word, position) of the indexed words of a file, its rarest licence words."""
        own = F.transform(words, lambda w, i: F.when(w.isin(self.words), F.struct((F.array_position(self.place_of, w) - 1).cast("int").alias("word"), i.alias("at"))))
        return F.filter(own, lambda h: h.isNotNull())

    def candidates(self, hits: Column) -> Column:
        """What the postings of the hits give: template and start of the key phrase in one number, and which anchor it was."""

        def looked_up(h: Column) -> Column:
            own = F.sequence(F.get(self.ends, h["word"]), F.get(self.ends, h["word"] + 1) - 1)
            return F.transform(own, lambda j: F.struct((F.get(self.template, j).cast("long") * (1 << 32) + h["at"] - F.get(self.at, j)).alias("place"), F.get(self.nth, j).alias("nth")))

        # a start before the text would run into the template's number
        return F.filter(F.flatten(F.transform(hits, looked_up)), lambda c: c["place"].bitwiseAND((1 << 32) - 1) < (1 << 31))

    def verified(self, both: Column, words: Column) -> Column:
        """(template, start, share) of the places where the key phrase stands."""
        own = F.transform(both, lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("t"), c.bitwiseAND((1 << 32) - 1).cast("int").alias("start")))
        key = lambda p: F.slice(self.text, F.get(self.start, p["t"]) + F.get(self.key_at, p["t"]) + 1, F.get(self.key_size, p["t"]))
        fits = F.filter(own, lambda p: F.slice(words, p["start"] + 1, F.get(self.key_size, p["t"])) == key(p))

        def share(p: Column) -> Column:
            there = lambda i: F.get(words, p["start"] - F.get(self.key_at, p["t"]) + i) == F.get(self.text, F.get(self.start, p["t"]) + i)
            return F.size(F.filter(F.sequence(F.lit(0), F.get(self.size, p["t"]) - 1), there)) / F.get(self.size, p["t"]).cast("double")

        return F.transform(fits, lambda p: F.struct(p["t"].alias("t"), p["start"].alias("start"), share(p).alias("share")))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, base_places, base_labels, labels, score).

    base_places: sorted starts (words from 0) of the base templates; labels: sorted and distinct; score: the best
    share of a matching template's words that are in place, 0 without one.
    """
    words = df.select(F.col(doc_id).alias("doc_id"), ascii_words(F.col(text)).alias("words"))
    index = Index(templates, frequencies(words, sorted({w for t in templates for w in t.key})))
    found = words.select("doc_id", "words", index.hits(F.col("words")).alias("hits"))
    found = found.select("doc_id", "words", index.candidates(F.col("hits")).alias("found"))
    of = lambda nth: F.transform(F.filter("found", lambda c: c["nth"] == nth), lambda c: c["place"])
    found = found.select("doc_id", "words", F.array_intersect(of(0), of(1)).alias("both"))
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), index.verified(F.col("both"), F.col("words")).alias("places"))
    base = F.filter("places", lambda p: F.get(index.base, p["t"]) == 1)
    labels = lambda own: F.array_sort(F.array_distinct(F.transform(own, lambda p: F.get(index.label, p["t"]))))
    found = found.select("doc_id", "n_words", base.alias("base"), F.filter("places", lambda p: p["share"] >= LEAST).alias("fair"))
    score = F.coalesce(F.array_max(F.transform("fair", lambda p: p["share"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.sort_array(F.transform("base", lambda p: p["start"])).alias("base_places"), labels(F.col("base")).alias("base_labels"), labels(F.col("fair")).alias("labels"), score.alias("score"))
