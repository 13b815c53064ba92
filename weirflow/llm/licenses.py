"""License scans by conditional compression.

Candidates are windows of words; lines, blank lines and comment signs don't matter. Of a template of n words that a text
holds to a share, some of any n - share * n + 1 words must be there. So many of each template's words, the longest ones, are
its anchors, and a window is laid around every anchor in the text so that it stands where the template has it. A window that
holds too few of the template's words (counted, in any order) is passed over. The words of the others are aligned with the
template, and the share of its wording that is there, and the words that differ, decide. What is confirmed is compressed
alone and with the template as a raw zstandard dictionary; the reduction in size must be large enough. Every confirmed place
is reported, but of places that overlap the one that holds most of its template's words (then: the fewest other words, the
largest share, the largest reduction) stands for all. A tag may name several licenses; each of them is a match.

Null and empty texts hold none. Matches are reported by place; last_line is the line after the match. Repeated rows are
scanned alike, columns of the names that are added are replaced, no rows give no rows.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame

from weirflow.llm.common import arrow_map

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GPL = "This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{comma} either version {v} of the License, or (at your option) any later version."
_GPL_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
#: Public license texts, where they are short, and the notices that files carry of the others.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "AGPL-3.0-or-later": _GPL.format(mark=":", comma=",", kind="Affero ", v=3),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD_GRANT + " " + _BSD_END,
    "BSD-2-Clause conditions": _BSD_GRANT,
    "BSD-3-Clause": _BSD_GRANT + " " + _BSD_NAMES + " " + _BSD_END,
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 short notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0 short notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-or-later": _GPL.format(mark=";", comma=";", kind="", v=2),
    "GPL-3.0-or-later": _GPL.format(mark=":", comma=",", kind="", v=3),
    "GPL-3.0-or-later long notice": _GPL.format(mark=":", comma=",", kind="", v=3) + _GPL_END,
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT grant": _MIT_GRANT,
    "MIT notice": "Released under the MIT License.",
    "MIT long notice": "This project is licensed under the terms of the MIT license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}
#: Identifiers that tags name.
TAGGED = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
TAG = "SPDX-License-Identifier:"
TEMPLATES |= {f"{x} tag": f"{TAG} {x}" for x in TAGGED}
WORD = re.compile(r"[\w.+-]*\w")


def wording(text: str) -> list[str]:
    return list(map(str.lower, WORD.findall(text)))


@dataclass
class Template:
    name: str
    words: list[str]
    packer: zstandard.ZstdCompressor
    count: Counter


class Scanner:
    def __init__(self, templates: dict[str, str], level: int = 9, least_reduction: float = 0.3, least_share: float = 0.85, most_new: float = 0.15):
        self.alone = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        self.templates = [self._template(n, t, level) for n, t in sorted(templates.items())]
        self.least_reduction, self.least_share, self.most_new = least_reduction, least_share, most_new
        #: word -> (template, place) of anchors
        self.anchors: dict[str, list[tuple[Template, int]]] = {}
        for t in self.templates:
            n = len(t.words)
            needed = n - math.ceil(least_share * n) + 1
            for place in sorted(range(n), key=lambda k: (-len(t.words[k]), k))[:needed]:
                self.anchors.setdefault(t.words[place], []).append((t, place))
        self.tags = {wording(x)[0]: f"{x} tag" for x in TAGGED if f"{x} tag" in templates}
        self.by_name = {t.name: t for t in self.templates}

    @staticmethod
    def _template(name: str, text: str, level: int) -> Template:
        words = wording(text)
        d = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return Template(name, words, packer, Counter(words))

    def windows(self, words: list[str]):
        """(template, from, to): windows of words that can hold a template, as the necessary number of its words is there."""
        found: dict[str, set[tuple[int, int]]] = {}
        for i, w in enumerate(words):
            for t, place in self.anchors.get(w, ()):
                new = int(self.most_new * len(t.words))
                found.setdefault(t.name, set()).add((max(0, i - place - new), min(len(words), i - place + len(t.words) + new)))
        for name, places in sorted(found.items()):
            t = self.by_name[name]
            least = self.least_share * len(t.words)
            for a, b in sorted(places):
                if sum(1 for w in words[a:b] if w in t.count) >= least and (Counter(words[a:b]) & t.count).total() >= least:
                    yield t, a, b

    def aligned(self, words: list[str], t: Template) -> tuple[int, int, int] | None:
        """(from, to, words in common) of the stretch that holds most of the template with few enough others, if it holds enough."""
        parts = [p for p in difflib.SequenceMatcher(None, words, t.words, autojunk=False).get_matching_blocks() if p.size]
        best = None
        for j in range(len(parts)):
            same = 0
            for p in parts[j:]:
                same += p.size
                a, b = parts[j].a, p.a + p.size
                if same >= self.least_share * len(t.words) and b - a - same <= self.most_new * len(t.words) and (best is None or (same, a - b) > (best[2], best[0] - best[1])):
                    best = a, b, same
        return best

    def reduction(self, words: list[str], t: Template) -> float:
        raw = " ".join(words).encode()
        return 1 - len(t.packer.compress(raw)) / len(self.alone.compress(raw))

    def confirmed(self, words: list[str]) -> dict[tuple[int, int, str], tuple]:
        """(from, to, template) -> (words in common, other words, share, reduction)."""
        places = {}
        for t, a, b in self.windows(words):
            hit = self.aligned(words[a:b], t)
            if hit:
                first, last, same = a + hit[0], a + hit[1], hit[2]
                if (first, last, t.name) not in places:
                    reduction = self.reduction(words[first:last], t)
                    if reduction >= self.least_reduction:
                        places[first, last, t.name] = same, last - first - same, same / len(t.words), reduction
        # further licenses that a tag names
        for first, last, name in [p for p in places if p[2].endswith(" tag")]:
            while last + 1 < len(words) and words[last] in ("or", "and") and words[last + 1] in self.tags:
                more = self.by_name[self.tags[words[last + 1]]]
                places[last, last + 2, more.name] = 2, 0, 1.0, self.reduction(more.words, more)
                last += 2
        return places

    def scan(self, text: str | None) -> list[dict]:
        words = wording(text) if text else []
        places = self.confirmed(words) if not self.anchors.keys().isdisjoint(words) else {}
        if not places:
            return []
        found = list(WORD.finditer(text))
        breaks = [m.start() for m in re.finditer("\n", text)]
        taken: list[tuple[int, int]] = []
        out = []
        for (first, last, name), (_, new, share, reduction) in sorted(places.items(), key=lambda x: (-x[1][0], x[1][1], -x[1][2], -x[1][3], x[0])):
            if all(last <= a or b <= first for a, b in taken):
                taken.append((first, last))
                lines = bisect_right(breaks, found[first].start()), bisect_right(breaks, found[last - 1].start()) + 1
                out.append((first, {"license": name, "first_line": lines[0], "last_line": lines[1], "reduction": reduction, "share": share, "new_words": new}))
        return [x for _, x in sorted(out, key=lambda x: x[0])]


def license_scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``licenses`` (array of license, first_line, last_line, reduction, share, new_words) and ``n_licenses`` to every row."""
    chosen = templates or TEMPLATES
    held: list[Scanner] = []

    def scan(texts):
        if not held:
            held.append(Scanner(chosen))
        out = [held[0].scan(t) for t in texts]
        return out, [len(x) for x in out]

    return arrow_map(docs, [text], scan, "licenses array<struct<license:string,first_line:int,last_line:int,reduction:double,share:double,new_words:int>>, n_licenses long", keep)
