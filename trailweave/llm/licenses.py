"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance.

Templates are whole short licences, the opening blocks of long ones and the notices that point to them. They and all
parts of a file are sparse TF-IDF vectors (weights from the templates themselves, so they are the same for any
corpus). A file's parts are the whole file, its blocks between empty lines (a header is one), its lines, their
sentences, and every run of words over line ends that starts with a line or a sentence and is as long as a template; parts without a rare word of a
template are left out: of a template's different words those that the fewest licenses have, one in ``RARE`` and three at
least, without words of up to four letters that are no marks, as most everyday words are. An SPDX tag may join several licenses by OR and
AND: the expression is the license if each matches its template, else the file has none. The best part decides the file's own license, if its cosine
reaches ``LEAST``, if it leads the best template of any other license by ``MARGIN``, and if it has just the marks of
the template: words that tell near relatives apart (``MARKS``: version numbers, lesser, affero, share-alike and so
on). A near relative without a template of its own is thus no license rather than a wrong one.

A file is a licence file of its directory if its name says so, or if the matching part makes up at least half of its
words. Files without a license inherit that of the nearest directory above that has one, by joins of directories with
the licence files' directories; of several licence files in one directory the best match counts, then the smallest
name.

Defined cases: a null or empty text has no license of its own; a null path has neither directory nor inheritance;
repeated rows are judged alike; of equally good licenses the first by name counts; texts and lines of any length and
case are judged the same way, whole; an empty table gives an empty result; a column of the input that is named like a
new one gives way to it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.shared import extended, written

#: Public licence texts and notices, by SPDX identifier.
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted"
_BSD_TERMS = (
    " provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. "
    "in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; "
    "loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, "
    "even if advised of the possibility of such damage"
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
_MIT_TERMS = (
    " and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, "
    "and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. "
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"


def _gnu(name: str, version: str) -> tuple[str, ...]:
    """Notices and opening blocks of a licence of the GNU family."""
    return (
        f"GNU {name} License Version {version}", f"This work is licensed under the GNU {name} License, version {version}",
        f"it under the terms of the GNU {name} License as published by the Free Software Foundation, version {version} of the License",
    )


def _later(name: str, version: str) -> tuple[str, ...]:
    """Notices that allow later versions of such a licence too."""
    return (
        f"it under the terms of the GNU {name} License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version",
        f"This work is licensed under the GNU {name} License, version {version} or any later version",
    )


def _cc(short: str, long: str) -> tuple[str, ...]:
    return (f"Licensed under CC {short} 4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License")


#: Texts of each license; "SPDX-License-Identifier: " and the name is one of each.
TEXTS = {
    "AGPL-3.0-only": _gnu("Affero General Public", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License"),
    "BSD-2-Clause": (_BSD + _BSD_TERMS + _BSD_END,),
    "BSD-3-Clause": (_BSD, _BSD + _BSD_TERMS + "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "GPL-2.0-only": (*_gnu("General Public", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0-only": (*_gnu("General Public", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "ISC": (_ISC, _ISC + ". the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, "
            "indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"),
    "LGPL-2.1-only": (*_gnu("Lesser General Public", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0-only": (*_gnu("Lesser General Public", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": ("Released under the MIT License", _MIT, _MIT + _MIT_TERMS + _AS_IS),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    "AGPL-3.0-or-later": _later("Affero General Public", "3"), "GPL-2.0-or-later": _later("General Public", "2"), "GPL-3.0-or-later": _later("General Public", "3"),
    "LGPL-2.1-or-later": _later("Lesser General Public", "2.1"), "LGPL-3.0-or-later": _later("Lesser General Public", "3"),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
}
TEMPLATES = {name: (*texts, f"SPDX-License-Identifier: {name}") for name, texts in TEXTS.items()}
#: Words that tell near relatives apart, and words that a version number follows.
MARKS = frozenset(
    "lesser affero later fdl mit bsd isc apache mozilla sharealike noncommercial noderivatives attribution attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike "
    "attribution-noncommercial-noderivatives by-sa by-nc by-nd by-nc-sa by-nc-nd cc0 endorse endorses".split())
_VERSIONED = frozenset("version v license licence gpl lgpl agpl mpl by".split()) | MARKS
LEAST, MARGIN, RARE = 0.6, 0.02, 4
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_SENTENCE = re.compile(r"[^.;|]+(?:\.\d[^.;|]*)*")
#: An SPDX tag with several licenses, and what joins them; brackets are taken off, so an expression reads from left to right.
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([\w.+()-]+(?:[ \t]+(?:or|and)[ \t]+[\w.+()-]+)+)")
_JOINS = re.compile(r"[ \t]+(or|and)[ \t]+")
_FILE = re.compile(r"(?:licen[cs]e|copying|unlicense|notice)(?:[.-][^/]*)?\Z", re.I)
def marks_of(words: list[str]) -> frozenset[str]:
    """The marks among words, and the version numbers."""
    versions = {f"#{w}" for before, w in pairwise(words) if w[0].isdigit() and before in _VERSIONED}
    return MARKS.intersection(words) | versions


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.names = [name for name, texts in templates.items() for _ in texts]
        bags = [Counter(_WORD.findall(t.lower())) for texts in templates.values() for t in texts]
        seen = Counter(w for b in bags for w in b)
        self.idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in seen.items()}
        self.unknown = math.log(1 + len(bags)) + 1
        self.marks = [marks_of(_WORD.findall(t.lower())) for texts in templates.values() for t in texts]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, bag in enumerate(bags):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in bag.items()))
            for w, n in bag.items():
                self.postings.setdefault(w, []).append((i, n * self.idf[w] / norm))
        # the rare words of the templates of each length, and of all
        having = Counter(w for texts in templates.values() for w in {w for x in texts for w in _WORD.findall(x.lower())})
        rare = [(b.total(), frozenset(sorted([w for w in b if len(w) > 4 or w in MARKS or not w.isalpha()] or b, key=lambda w: (having[w], -self.idf[w], w))[: max(3, len(b) // RARE)])) for b in bags]
        self.lengths = {n: frozenset().union(*(r for m, r in rare if m == n)) for n in sorted({m for m, _ in rare})}
        self.telling = frozenset().union(*(r for _, r in rare))

    def match(self, words: list[str]) -> tuple[float, str | None, int]:
        """Best cosine with a template that has the same marks, its license if it leads by ``MARGIN``, and the number of words."""
        bag = Counter(words)
        if self.telling.isdisjoint(bag):
            return 0.0, None, len(words)
        dots: Counter = Counter()
        for w, n in bag.items():
            for i, v in self.postings.get(w, ()):
                dots[i] += n * self.idf[w] * v
        norm = math.sqrt(sum((n * self.idf.get(w, self.unknown)) ** 2 for w, n in bag.items()))
        marks = marks_of(words)
        by_name: dict[str, float] = {}
        for i, dot in dots.items():
            if self.marks[i] == marks:
                by_name[self.names[i]] = max(by_name.get(self.names[i], 0.0), round(dot / norm, 9))
        if not by_name:
            return 0.0, None, len(words)
        name = min(by_name, key=lambda n: (-by_name[n], n))
        second = max((v for n, v in by_name.items() if n != name), default=0.0)
        return by_name[name], name if by_name[name] - second >= MARGIN else None, len(words)

    def parts(self, text: str) -> Iterator[list[str]]:
        """Words of the whole text, its blocks, lines, sentences, and of windows over line ends, where they hold a rare word."""
        raw = text.split("\n")
        lines = [_WORD.findall(line) for line in raw]
        flat = [w for words in lines for w in words]
        yield flat
        block: list[list[str]] = []
        for line, words in zip([*raw, ""], [*lines, []], strict=True):
            if words:
                block.append(words)
            elif not line.strip(" \t\r*#/;-"):  # an empty line, also one of a comment
                if len(block) > 1:
                    yield [w for part in block for w in part]
                block = []
        for line, words in zip(raw, lines, strict=True):
            if self.telling.isdisjoint(words):
                continue
            yield words
            sentences = _SENTENCE.findall(line)
            if len(sentences) > 1:
                yield from map(_WORD.findall, sentences)
        line_of, starts, at = [i for i, words in enumerate(lines) for _ in words], [], 0
        for line, words in zip(raw, lines, strict=True):
            begun = set(accumulate(len(_WORD.findall(x)) for x in _SENTENCE.findall(line))) | {0}
            starts += [at + i for i in sorted(begun) if i < len(words)]
            at += len(words)
        done = set()
        for at, word in enumerate(flat):
            if word in self.telling:
                for n, rare in self.lengths.items():
                    if word in rare:
                        for lo in starts[bisect_right(starts, at - n) : bisect_right(starts, min(at, len(flat) - n))]:
                            if line_of[lo] != line_of[lo + n - 1] and (lo, n) not in done:
                                done.add((lo, n))
                                yield flat[lo : lo + n]

    def expression(self, text: str) -> tuple[bool, str | None]:
        """Whether a tag joins several licenses, and the expression if each has a template of its own."""
        if not (found := _TAGGED.search(text)):
            return False, None
        parts = _JOINS.split(found[1].strip())
        matched = [self.match(["spdx-license-identifier", *_WORD.findall(p.strip("() "))]) for p in parts[::2]]
        if any(name is None or cosine < 0.999 for cosine, name, _ in matched):
            return True, None
        names = [name for _, name, _ in matched]
        return True, " ".join([names[0], *(x for op, name in zip(parts[1::2], names[1:], strict=True) for x in (op.upper(), name))])

    def scan(self, text: str | None) -> tuple[float, str | None, bool]:
        """Cosine and license of a text's best part, and whether that part is half of the text."""
        best, name, size = 0.0, None, 0
        text = (text or "").lower()
        several, told = self.expression(text)
        if several:
            return float(told is not None), told, told is not None and 2 * len(_WORD.findall(told)) + 2 >= len(_WORD.findall(text))
        for words in () if self.telling.isdisjoint(_WORD.findall(text)) else self.parts(text):
            cosine, found, n = self.match(words)
            if found and (cosine > best or (cosine == best and name is not None and (found, -n) < (name, -size))):
                best, name, size = cosine, found, n
        if best < LEAST:
            return best, None, False
        return best, name, 2 * size >= len(_WORD.findall(text))


def scan_texts(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``files`` with own_license, cosine and mostly_license."""
    new = {"own_license": "string", "cosine": "double", "mostly_license": "boolean"}
    files = files.drop(*[c for c in files.columns if c.lower() in new])
    at = [c.lower() for c in files.columns].index("text")
    schema = extended(files, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            rows = [known.scan(t.as_py()) for t in batch.column(at)]
            columns = zip(*[(name, cosine, most) for cosine, name, most in rows], strict=True) if rows else ((),) * 3
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new])

    return files.mapInArrow(run, schema)


def inherit(scanned: DataFrame) -> DataFrame:
    """``scanned`` (path, own_license, cosine, mostly_license) with license and inherited_from (a directory, or null)."""
    scanned = scanned.drop(*[c for c in scanned.columns if c.lower() in ("license", "inherited_from")])
    directory = F.when(F.col("path").isNotNull(), F.regexp_replace("path", r"[^/]*\z", ""))
    named = scanned.withColumn("_tw_dir", directory)
    is_file = F.col("mostly_license") | F.regexp_replace("path", r"^.*/", "").rlike(rf"(?i)^{_FILE.pattern.replace(chr(92) + 'Z', '$')}")
    licensed = named.filter(F.col("own_license").isNotNull() & is_file & F.col("_tw_dir").isNotNull())
    of_dir = licensed.groupBy("_tw_dir").agg(F.min_by("own_license", F.struct(-F.col("cosine"), "path", "own_license")).alias("license"))
    # each directory, once, with all above it: /a/b/ has /a/b/, /a/ and /
    directories = named.select("_tw_dir").filter("_tw_dir IS NOT NULL").distinct()
    parts = F.split("_tw_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    ladder = directories.select("_tw_dir", F.explode(above).alias("up"))
    nearest = ladder.join(of_dir.withColumnRenamed("_tw_dir", "up"), "up").groupBy("_tw_dir").agg(F.max_by(F.struct("up", "license"), F.length("up")).alias("_tw_near"))
    joined = named.join(nearest, "_tw_dir", "left")
    own = F.col("own_license")
    return joined.select(*[F.col(f"`{c}`") for c in scanned.columns], F.coalesce(own, F.col("_tw_near.license")).alias("license"), F.when(own.isNull(), F.col("_tw_near.up")).alias("inherited_from"))


def license_scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``files`` (path, text and others; texts are dropped) with own_license, cosine, mostly_license, license, inherited_from."""
    scanned = written(scan_texts(files, templates).drop("text"), "scanned")
    return inherit(scanned)
