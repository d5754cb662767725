"""License scans: sparse TF-IDF cosine against templates, then inheritance from the nearest ancestor directory.

A text is cut into segments, at line ends and at the ends of sentences, so that neither a notice wrapped over comment lines nor one inside a long line is
lost. Windows of consecutive segments are compared with the templates: one-sentence notices, whole headers, whole licence texts, and the titles that
long licences begin with. Window and template are vectors of word weights (count x inverse document frequency). Document frequencies of the template words are
counted over all documents; words that no template holds weigh as much as a word of no document, so a window with foreign words moves
away from every template. A window counts when every segment of it has half of its weight or more in template words, one of its words
is a licence word (``ANCHORS``), and it has 0.6 to 1.6 times the words of the template. A text takes the template with the largest cosine if it is
``min_cosine`` or more. A file is a licence file when half of its words or more are in such windows, or a title is among its first
``TITLE_WITHIN`` segments; it licenses its directory. A file without a licence of its own takes that of its nearest licensed ancestor directory, by joins on paths.

Defined results: null or empty text has no licence; null paths have no directory and inherit nothing; repeated rows give repeated results;
several licences in one directory: the most frequent, then the first by name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, stage, text_of

# Public licence notices, headers and texts.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
    "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission. "
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", _BSD + _BSD_END],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        _BSD + _BSD3 + _BSD_END,
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0", _GPL.format(2)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", _GPL.format(3)],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.", "SPDX-License-Identifier: ISC",
    ],
    "MIT": [
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "SPDX-License-Identifier: MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. " + _AS_IS,
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
# What long licence texts begin with.
TITLES = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
ANCHORS = {"license", "licenses", "licensed", "licence", "permission", "redistribution", "spdx"}
TITLE_WITHIN = 4
SHORTEST, LONGEST = 0.6, 1.6
ANY_ANCHOR = re.compile("licen[sc]e|permission|redistribution|spdx", re.IGNORECASE)
SEGMENT_END = re.compile(r"\n|(?<=[.!?;:])[ \t]+")
WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")


def tokens(line: str) -> list[str]:
    return [w.lower() for w in WORD.findall(line)]


def segments(text: str) -> list[list[str]]:
    """Words of each line or sentence that has some."""
    return [w for w in map(tokens, SEGMENT_END.split(text)) if w]


class Templates:
    """Weighted template vectors of length 1, by word."""

    def __init__(self, frequency: dict[str, int], documents: int, templates: dict[str, list[str]], titles: dict[str, str]):
        self.new = math.log((1 + documents) / 1) + 1
        lists = [(name, Counter(tokens(t)), False) for name, ts in templates.items() for t in ts] + [(name, Counter(tokens(t)), True) for name, t in titles.items()]
        vocabulary = {w for _, c, _ in lists for w in c}
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1 for w in vocabulary}
        self.names, self.sizes, self.title = [n for n, _, _ in lists], [sum(c.values()) for _, c, _ in lists], [t for _, _, t in lists]
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for i, (_, c, _) in enumerate(lists):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            for w, n in c.items():
                self.by_word.setdefault(w, []).append((i, n * self.idf[w] / norm))
        self.most = int(LONGEST * max(self.sizes))

    def like(self, segment: list[str]) -> bool:
        """Half of the weight of a segment is in words of templates."""
        weight = {w: (n * self.idf.get(w, self.new)) ** 2 for w, n in Counter(segment).items()}
        return 2 * sum(x for w, x in weight.items() if w in self.idf) >= sum(weight.values())

    def windows(self, text: str, least: float) -> tuple[str | None, float, bool]:
        """(licence, cosine, licence file) of the nearest template."""
        if not ANY_ANCHOR.search(text):
            return None, 0.0, False
        parts = segments(text)
        anchor = [not ANCHORS.isdisjoint(p) for p in parts]
        near = [self.like(p) for p in parts]
        covered, best, titled = bytearray(len(parts)), (0.0, ""), False
        for i in range(len(parts)):
            if not near[i]:
                continue
            count: Counter = Counter()
            dots: Counter = Counter()
            square, n, seen = 0.0, 0, False
            for j in range(i, len(parts)):
                if not near[j] or n > self.most:
                    break
                seen = seen or anchor[j]
                for w in parts[j]:
                    x = self.idf.get(w, self.new)
                    square += (2 * count[w] + 1) * x * x
                    count[w] += 1
                    n += 1
                    for t, v in self.by_word.get(w, ()):
                        dots[t] += x * v
                if not seen:
                    continue
                norm = math.sqrt(square)
                for t, dot in dots.items():
                    if dot >= least * norm and SHORTEST * self.sizes[t] <= n <= LONGEST * self.sizes[t] and (not self.title[t] or i < TITLE_WITHIN):
                        covered[i:j + 1] = b"\1" * (j + 1 - i)
                        titled = titled or self.title[t]
                        best = max(best, (min(1.0, dot / norm), self.names[t]))
        own = sum(len(p) for p, c in zip(parts, covered) if c)
        return best[1] or None, best[0], bool(own) and (titled or 2 * own >= sum(map(len, parts)))


def template_frequencies(docs: DataFrame, text: str, templates: list[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each template word, and all documents. The vocabulary of the templates bounds what is counted."""
    vocabulary = sorted({w for t in templates for w in tokens(t)})
    found = F.array_intersect(F.array_distinct(F.regexp_extract_all(ascii_lower(text_of(F.col(text))), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*+"), F.lit(0))), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    return counts, counts.pop("", 0)


def own_licenses(docs: DataFrame, keys: list[str], text: str = "text", min_cosine: float = 0.8, templates: dict[str, list[str]] | None = None, titles: dict[str, str] | None = None) -> DataFrame:
    """The string columns ``keys`` of each row, license (null: none), cosine, is_license_file."""
    templates, titles = TEMPLATES if templates is None else templates, TITLES if titles is None else titles
    every = [x for ts in templates.values() for x in ts] + list(titles.values())
    t = Templates(*template_frequencies(docs, text, every), templates, titles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [t.windows(body if isinstance(body, str) else "", min_cosine) for body in pdf["_b_text"]]
            rows = [(name, value if name else None, whole) for name, value, whole in found]
            out = pdf[keys].copy()
            out[["license", "cosine", "is_license_file"]] = pd.DataFrame(rows, index=pdf.index, columns=["license", "cosine", "is_license_file"])
            yield out

    d = docs.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(text).cast("string").alias("_b_text"))
    return d.mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", license string, cosine double, is_license_file boolean")


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` (path, license, is_license_file, ...) with inherited_license and inherited_from.

    A file meets its ancestors through the directories that hold a licence file: one row per licensed directory, not per file. One
    join per depth of such directories, the deepest first.
    """
    folder = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_extract(p, r"^([\s\S]*)/[^/]*$", 1))
    depth = lambda p: F.size(F.split(p, "/"))
    votes = files.filter("is_license_file").select(folder(F.col(path)).alias("_b_dir"), "license").filter("_b_dir is not null")
    votes = votes.groupBy("_b_dir", "license").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("_b_dir").orderBy(F.desc("n"), "license"))
    licensed = stage(votes.withColumn("r", first).filter("r = 1").select("_b_dir", F.col("license").alias("_b_license"), depth(F.col("_b_dir")).alias("_b_depth")), "licensed")
    depths = sorted((r[0] for r in licensed.select("_b_depth").distinct().collect()), reverse=True)
    out = files.withColumn("_b_at", folder(F.col(path)))
    found, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in depths:
        level = licensed.filter(F.col("_b_depth") == d).select(F.col("_b_dir").alias(f"_b_dir{d}"), F.col("_b_license").alias(f"_b_lic{d}"))
        ancestor = F.when(depth(F.col("_b_at")) >= d, F.substring_index("_b_at", "/", d))
        out = out.join(level, ancestor == F.col(f"_b_dir{d}"), "left")
        found, source = F.coalesce(found, F.col(f"_b_lic{d}")), F.coalesce(source, F.col(f"_b_dir{d}"))
    own = F.col("license").isNotNull()
    return out.select(*files.columns, F.when(~own, found).alias("inherited_license"), F.when(~own, source).alias("inherited_from"))
