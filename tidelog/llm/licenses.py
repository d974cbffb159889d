"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of the text with a word and, with ``wrapped``, also any window of as many
words as the template has, wherever lines break; its tokens are its distinct words.  Block B
meets template T when |B and T| >= threshold * |T|.  Only tokens of templates can match,
so they alone are put in a global order, rarest first by the number of blocks in the whole
corpus that hold them (one small row for each template token comes to the driver; the
templates are a bounded parameter).  Then, with need = ceil(threshold * |T|):
  prefix filter      B holds one of the |T| - need + 1 rarest tokens of T;
  length filter      B has need tokens of templates at least;
  positional filter  at a shared prefix token, what either side still has reaches need.
What is left is confirmed on the full sets, so no block is missed.  Windows are slid only over
texts that pass the filters as one block, as each window is a part of its text.

Phrases are places where a phrase's words stand consecutively anywhere in the text.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows
are scanned each; texts of any length are scanned whole; only the id and the text are
read, so other columns never clash.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices as they stand in files and pages; label -> notice.  A parameter, at most MAX_TEMPLATES.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "apache-2": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2": "This program is free software under the GNU General Public License, version 2.",
    "lgpl": "This library is licensed under the GNU Lesser General Public License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc0": "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    "rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
}
#: The same with the headers that licences ask for and what opens or marks their full texts.
NOTICES: dict[str, tuple[str, ...]] = {label: (notice,) for label, notice in TEMPLATES.items()}
for _label, _notice in (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("rights-reserved", "All rights reserved."),
):
    NOTICES[_label] = (*NOTICES.get(_label, ()), _notice)
# Whole texts of the short standard licences, from their grant to their disclaimer, without names.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
FULL_TEXTS = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_AS_IS,
    "bsd-2": f"{_BSD_TERMS} {_BSD_AS_IS}",
    "bsd-3": f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_AS_IS}",
    "isc": f"{NOTICES['isc'][0]} {_ISC_AS_IS}",
    "mit": f"{NOTICES['mit'][1]} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS,
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
for _label, _notice in FULL_TEXTS.items():
    NOTICES[_label] = (*NOTICES.get(_label, ()), _notice)
MAX_TEMPLATES = 10_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes know A-Z only


def words(text: str) -> list[str]:
    return WORD.findall(lower_ascii(text))


def listed(templates: Mapping[str, str | Sequence[str]]) -> list[tuple[str, str]]:
    """(label, notice); a label has one notice or several."""
    return [(label, n) for label, notices in sorted(templates.items()) for n in ([notices] if isinstance(notices, str) else notices)]


class TemplateIndex:
    """Templates under a global token order, with the inverted index of their prefixes."""

    def __init__(self, templates: Mapping[str, str | Sequence[str]], counts: Mapping[str, int], threshold: float):
        notices = listed(templates)
        if len(notices) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.labels, self.sets, self.lengths = zip(*((label, frozenset(words(t)), len(words(t))) for label, t in notices), strict=True) if notices else ((), (), ())
        tokens = sorted({w for s in self.sets for w in s}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(tokens)}
        # Integer arithmetic on thousandths, so that the bound is the same everywhere.
        self.need = [-(-round(threshold * 1000) * len(s) // 1000) for s in self.sets]
        self.least = min((n for n in self.need if n), default=math.inf)
        self.prefix: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for t, s in enumerate(self.sets):
            for at, w in enumerate(sorted(s, key=self.rank.__getitem__)[: len(s) - self.need[t] + 1]):
                self.prefix[w].append((t, at))

    def matches(self, tokens: set[str]) -> dict[int, float]:
        """Template number -> containment, of those that the block's tokens meet."""
        known = sorted((w for w in tokens if w in self.rank), key=self.rank.__getitem__)
        found: dict[int, float] = {}
        if len(known) < self.least:  # length filter
            return found
        tried: set[int] = set()
        for at, w in enumerate(known):
            for t, there in self.prefix.get(w, ()):
                if t in tried:
                    continue
                tried.add(t)  # the first shared prefix token is the rarest shared token
                if 1 + min(len(known) - at - 1, len(self.sets[t]) - there - 1) < self.need[t]:  # positional filter
                    continue
                share = len(self.sets[t].intersection(known))
                if share >= self.need[t]:
                    found[t] = share / len(self.sets[t])
        return found

    def passages(self, t: int, places: Mapping[str, list[int]]) -> list[tuple[int, int, float]]:
        """(first, last word, best containment) of each run of windows that meet a template."""
        at = sorted((p, w) for w in self.sets[t] for p in places.get(w, ()))
        held: Counter[str] = Counter()
        out: list[tuple[int, int, float]] = []
        low = best = 0
        start = end = -1
        for p, w in at:
            held[w] += 1
            while at[low][0] <= p - self.lengths[t]:
                old = at[low][1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                low += 1
            if len(held) < self.need[t]:
                continue
            if start >= 0 and at[low][0] > end:
                out.append((start, end, best / len(self.sets[t])))
                start = -1
            if start < 0:
                start, best = at[low][0], 0
            best, end = max(best, len(held)), p
        return [*out, (start, end, best / len(self.sets[t]))] if start >= 0 else out


def token_counts(docs: DataFrame, templates: Mapping[str, str | Sequence[str]], text_col: str = "text") -> dict[str, int]:
    """Blocks of the whole corpus that hold each template token; one row a token."""
    vocabulary = frozenset(w for _, t in listed(templates) for w in words(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                for line in lower_ascii(value.as_py() or "").split("\n"):
                    total.update(vocabulary.intersection(WORD.findall(line)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    parts = docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, "token string, n long")
    return {r["token"]: r["n"] for r in parts.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """For each row of ``docs``: the id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the best containment), and matches: each block that meets a template,
    as (line number, label, containment).  With ``wrapped``, passages that no single line meets as
    well are matches too, under their first line's number."""
    index = TemplateIndex(templates, token_counts(docs, templates, text_col), threshold)
    spoken = [(" " + " ".join(words(p)) + " ", label) for p, label in sorted(phrases.items()) if words(p)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(1):
                places, base, hits, ends, all_words = [], set(), [], [], []
                for line_no, line in enumerate(lower_ascii(value.as_py() or "").split("\n")):
                    found = WORD.findall(line)
                    if found:
                        hits += [(line_no, t, c) for t, c in sorted(index.matches(set(found)).items())]
                    all_words += found
                    ends.append(len(all_words))
                n = len(all_words)
                if n and wrapped:
                    places_of: dict[str, list[int]] = defaultdict(list)
                    for k, w in enumerate(all_words):
                        if w in index.rank:
                            places_of[w].append(k)
                    on_lines: dict[int, list[tuple[int, float]]] = defaultdict(list)
                    for line_no, t, c in hits:
                        on_lines[t].append((line_no, c))
                    for t in sorted(index.matches(set(places_of))):
                        for first, last, c in index.passages(t, places_of):
                            top, bottom = bisect_right(ends, first), bisect_right(ends, last)
                            lines = on_lines[t][bisect_left(on_lines[t], (top, 0.0)) : bisect_left(on_lines[t], (bottom + 1, 0.0))]
                            if not any(share >= c for _, share in lines):
                                hits.append((top, t, c))
                    hits.sort()
                hits = [(k, index.labels[t], c) for k, t, c in hits]
                if n:
                    flat, starts = f" {' '.join(all_words)} ", None
                    for phrase, label in spoken:
                        at = flat.find(phrase)
                        while at >= 0:
                            # The space before each word, in order, so that a place is found by bisection.
                            starts = starts or list(accumulate((len(w) + 1 for w in all_words), initial=0))
                            places.append(bisect_left(starts, at))
                            base.add(label)
                            at = flat.find(phrase, at + 1)
                labels = base | {label for _, label, _ in hits}
                out.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((c for *_, c in hits), default=0.0), [{"line": k, "label": label, "containment": c} for k, label, c in hits]))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    schema = f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<line:bigint,label:string,containment:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
