"""License scans by patience alignment with license templates.

A text and a template are word sequences. Words that occur once in both are
anchors; the longest increasing run of their positions is kept, and the gaps
between kept anchors are aligned in the same way. A gap without anchors keeps
its common ends and a longest common subsequence, found in linear space.
Coverage is the share of the template's words that are aligned.

A passage is a window of the template's length and a quarter more (three words
at least) that covers the share ``least`` of the template; where more words
than that are put in, no passage is found. Three exact filters come first. A
text that covers that share has one word of any set of more than the other
share of the template's words, so a few rare words of each template decide
whether a text is split at all. A window must hold that many words of the
template, and a common subsequence of that length, which bit vectors count
fast. All passages of a text are found, from left to right.

The built-in templates are notices and headers of common licenses and the
bodies of short ones; longer bodies can be given.

Rows: null and empty texts have no passages; repeated rows give repeated
passages; of overlapping passages the one of more aligned words stays, then
that of more coverage, the earlier, and the first by name; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import ceil

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from assetloom.llm.arrow import map_chunks

LEAST = 0.8
WORD = re.compile(r"\w+(?:[.\-]\w+)*")

#: Notices, permission texts and bodies of common licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-body": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


def split_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words and their spans."""
    spans = [m.span() for m in WORD.finditer(text)]
    return [text[s:e].lower() for s, e in spans], spans


def rising_run(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k:
            before[i] = last[k - 1]
        if k == len(tails):
            tails.append(v)
            last.append(i)
        else:
            tails[k], last[k] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        longer = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(longer, out=row[1:])
    return row


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, by halving: the best cut of the one for each half of the other."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (a, b))
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        if ahi - alo == 1:
            found = np.flatnonzero(y[blo:bhi] == x[alo])
            out += [(alo, blo + int(found[0]))] if len(found) else []
            continue
        mid = (alo + ahi) // 2
        cut = blo + int((_lengths(x[alo:mid], y[blo:bhi]) + _lengths(x[mid:ahi][::-1], y[blo:bhi][::-1])[::-1]).argmax())
        todo += [(alo, mid, blo, cut), (mid, ahi, cut, bhi)]
    return sorted(out)


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words of a text and a template, increasing in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            pairs.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            pairs.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {a[i]: i for i in range(alo, ahi) if in_a[a[i]] == 1 and in_b[a[i]] == 1}
        shared = [(place[b[j]], j) for j in range(blo, bhi) if b[j] in place]
        anchors = [shared[k] for k in rising_run([i for i, _ in shared])]
        if not anchors:
            pairs += [(alo + i, blo + j) for i, j in common_subsequence(a[alo:ahi], b[blo:bhi])]
            continue
        pairs += anchors
        for (i, j), (k, m) in zip([(alo - 1, blo - 1), *anchors], [*anchors, (ahi, bhi)]):
            if k > i + 1 and m > j + 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(pairs)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.least = name, least
        self.words = split_words(text)[0]
        self.places: dict[str, int] = {}
        for k, word in enumerate(self.words):
            self.places[word] = self.places.get(word, 0) | 1 << k
        self.need = ceil(least * len(self.words))
        self.window = len(self.words) + max(3, len(self.words) // 4)
        rare = sorted(range(len(self.words)), key=lambda i: (-len(self.words[i]), i))
        self.triggers = {self.words[i] for i in rare[: len(self.words) - self.need + 1]}

    def common(self, bits: list[int], begin: int, end: int) -> int:
        """Length of the longest common subsequence of some words and the template; ``bits`` has each word's places in it."""
        full = (1 << len(self.words)) - 1
        open_ = full  # a zero stands for a step of the length
        for k in range(begin, end):
            here = open_ & bits[k]
            open_ = ((open_ + here) | (open_ - here)) & full
        return len(self.words) - open_.bit_count()

    def passages(self, words: list[str]) -> list[tuple[int, int, int]]:
        """``(first word, last word, aligned words)`` of each passage, from left to right."""
        own = [i for i, w in enumerate(words) if w in self.places]
        bits = [self.places[words[i]] for i in own]
        out: list[tuple[int, int, int]] = []
        k = 0
        while k + self.need <= len(own):
            begin = own[k]
            if own[k + self.need - 1] >= begin + self.window:
                k += 1
                continue
            end = bisect_left(own, begin + self.window, k)
            if self.common(bits, k, end) < self.need:
                k += 1
                continue
            pairs = align(words[begin : begin + self.window], self.words)
            if len(pairs) >= self.need:
                last = begin + pairs[-1][0]
                out.append((begin + pairs[0][0], last, len(pairs)))
                k = bisect_left(own, last + 1)
            else:
                k += 1
        return out


def trigger_index(templates: list[Template]) -> ahocorasick.Automaton:
    """All triggers in one automaton, each with the numbers of its templates."""
    of: dict[str, list[int]] = {}
    for k, template in enumerate(templates):
        for word in template.triggers:
            of.setdefault(word, []).append(k)
    index = ahocorasick.Automaton()
    for word, numbers in of.items():
        index.add_word(word, tuple(numbers))
    index.make_automaton()
    return index


def find_licenses(text: str, templates: list[Template], triggers: ahocorasick.Automaton | None = None) -> list[tuple[str, int, int, int, int]]:
    """``(license, start, end, aligned, template words)`` of a text, without passages inside better ones."""
    if not templates:
        return []
    triggers = triggers or trigger_index(templates)
    hit = {numbers for _, numbers in triggers.iter(text.lower())}
    if not hit:
        return []
    live = [templates[k] for k in sorted({k for numbers in hit for k in numbers})]
    words, spans = split_words(text)
    found = [(t.name, spans[a][0], spans[b][1], n, len(t.words)) for t in live for a, b, n in t.passages(words)]
    found.sort(key=lambda x: (-x[3], -x[3] / x[4], x[1], x[0]))
    kept: list[tuple[str, int, int, int, int]] = []
    for x in found:
        if not any(x[1] < k[2] and k[1] < x[2] for k in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[1], x[0]))


SCHEMA = "doc_id long, license string, start long, end long, aligned long, template_words long, passage string"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Return one row per license passage: ``doc_id, license, start, end, coverage, aligned, template_words, passage``.

    Positions are code points. Of overlapping passages the one with most
    aligned words stays. The templates are a bounded list.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    listed = dict(templates or TEMPLATES)

    def make():
        compiled = [Template(n, t, least) for n, t in listed.items() if split_words(t)[0]]
        triggers = trigger_index(compiled)

        def step(batch):
            out: list[tuple] = []
            for name, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                out += [(name, *x, body[x[1] : x[2]]) for x in find_licenses(body or "", compiled, triggers)]
            columns = list(zip(*out)) if out else [[]] * 7
            return dict(zip(("doc_id", "license", "start", "end", "aligned", "template_words", "passage"), columns))

        return step

    found = map_chunks(given, make, SCHEMA)
    coverage = (F.col("aligned") / F.col("template_words")).alias("coverage")
    return found.select("doc_id", "license", "start", "end", coverage, "aligned", "template_words", "passage")
