"""Licence scan: Dice coefficient over word bigrams, DataFrame operations only.

Every line, every paragraph of several lines and every whole text of several
paragraphs is normalised (A-Z folded; words are runs of letters and digits) and
compared with licence templates.  For sets of A and B bigrams a coefficient of
t takes min(A, B) / max(A, B) >= t / (2 - t), so the size of a unit leaves a few
templates only; the others are never intersected.  Units outside all bounds
don't even get bigrams.  Nothing is shuffled.

A unit that reaches t with a template of B bigrams shares t / (2 - t) * B of
them at least.  So for each template a few words are chosen whose bigrams are
more than the rest: a unit, or a whole text, without any of the chosen words
can't match and isn't taken apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of

THRESHOLD = 0.75

# Notices, headers and whole texts of public licences, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Released under the BSD License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
}

_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> set[str]:
    """Word bigrams of a template; a text of one word has that word."""
    words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text.translate(str.maketrans(_UPPER, _LOWER))).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words)


def _units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, unit, unit_no, body): lines, paragraphs of several lines, texts of several paragraphs."""
    lines = f"transform(split(`{text}`, '\n', -1), (x, i) -> named_struct('unit', 'line', 'unit_no', i, 'body', x))"
    parts = f"filter(transform(split(`{text}`, '\n[ \\t\\r]*\n', -1), (x, i) -> named_struct('unit', 'paragraph', 'unit_no', i, 'body', x)), x -> contains(trim(BOTH '\n' FROM x.body), '\n'))"
    whole = f"if(`{text}` RLIKE '\n[ \\t\\r]*\n', array(named_struct('unit', 'text', 'unit_no', 0, 'body', `{text}`)), array())"
    return docs.select(F.col(doc_id).alias("doc_id"), F.expr(f"inline(concat({lines}, {parts}, {whole}))"))


def _least_share(threshold: float) -> float:
    return threshold / (2 - threshold)


#: Words that are rare in other texts; anchors are taken from them where they suffice.
JARGON = frozenset("apache bsd cc commons governed conditions copies copyright creative disclaimer distribute distribution documentation gnu granted license licensed mit modification modify mozilla mpl nc notice permission permitted redistribution redistributions released software sublicense unencumbered warranties".split())


def anchors(known: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with a template has one."""
    chosen: set[str] = set()
    for _, grams in sorted(known, key=lambda k: len(k[1])):
        pairs = [set(g.split(" ")) for g in grams]
        while len(open_ := [p for p in pairs if not p & chosen]) >= _least_share(threshold) * len(pairs) * (1 - 1e-9):
            words = sorted({w for p in open_ for w in p})
            chosen.add(max(words, key=lambda w: (w in JARGON, len(w) > 4, sum(w in p for p in open_), len(w), w)))
    return sorted(chosen)


def _has_any(words: list[str]) -> Column:
    """Whether column low has one of the words."""
    # a text with a word has the word's parts too
    least = [w for w in words if not any(v != w and v in w for v in words)]
    return reduce(lambda a, b: a | b, [F.col("low").contains(w) for w in least])


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit, unit_no, licence, dice) for each unit and the licence
    that it matches best, if its coefficient reaches the threshold; ties go to
    the first licence by name.

    Null and empty texts match nothing, and an empty table gives no row; rows
    with a null doc_id are scanned and give a null doc_id; an id may be of any
    type; repeated rows give repeated results.  Other columns are not read.
    """
    known = sorted((name, sorted(b)) for name, many in (TEMPLATES if templates is None else templates).items() for t in many if (b := bigrams(t)))
    share = _least_share(threshold)
    sizes = [len(b) for _, b in known]
    if not known:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind_of(docs, doc_id)}, unit string, unit_no int, licence string, dice double")
    keys = anchors(known, threshold)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # exploding one value keeps the optimiser from folding the text's case once for each word
    lowered = lambda df, c: df.withColumn("low", F.explode(F.array(F.lower(c)))).where(_has_any(keys)).drop("low")
    units = lowered(_units(lowered(rows, "text"), "doc_id", "text"), "body")
    # n bigrams take n + 1 words of one letter or more, and n blanks; repeated bigrams only make them fewer
    least = int(min(sizes) * share)
    units = units.where(F.length("body") >= (2 * least + 1 if least > 1 else 1))
    words = units.select("doc_id", "unit", "unit_no", F.explode(F.array(F.regexp_extract_all(F.translate("body", _UPPER, _LOWER), F.lit(_WORD), F.lit(0)))).alias("words")).where(F.size("words") >= int(min(sizes) * share))
    pairs = "if(size(words) < 2, words, transform(slice(words, 1, size(words) - 1), (w, i) -> concat(w, ' ', words[i + 1])))"
    # exploding one value keeps the optimiser from writing the expression out at each of its many uses
    sets = words.select("doc_id", "unit", "unit_no", F.explode(F.array(F.array_distinct(F.expr(pairs)))).alias("grams"))

    def score(name: str, grams: list[str]) -> Column:
        n = F.size("grams")
        both = F.size(F.array_intersect("grams", F.array(*map(F.lit, grams))))
        near = (n >= share * len(grams)) & (n * share <= len(grams))
        return F.struct(F.when(near, -2.0 * both / (n + len(grams))).otherwise(F.lit(0.0)).alias("less"), F.lit(name).alias("licence"))

    low, high = min(sizes) * share, max(sizes) / share
    best = F.array_min(F.array(*[score(*k) for k in known]))
    found = sets.where((F.size("grams") >= low) & (F.size("grams") <= high)).select("doc_id", "unit", "unit_no", F.explode(F.array(best)).alias("best"))
    return found.where(F.col("best.less") <= -threshold).select("doc_id", "unit", "unit_no", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("dice"))
