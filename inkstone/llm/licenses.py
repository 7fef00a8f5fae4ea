"""Licence scans by sentence rules.

A text is cut into pieces at sentence ends and newlines, each is normalised (lower case, words only). A known licence
sentence is one piece, or several in a row with no blank line between (a line of marks alone, as in comments, is blank),
so that wrapped and commented texts are read like others; it begins and ends where pieces do, and the longest one counts.
A line that goes on the sentence before it is not numbered anew. The identifiers found, in order, are matched against
ordered licence rules, longest rule first, with at most GAP sentences of other content between two of a rule; a sentence
is used by one match only.

The catalogue holds the whole wording of short licences and of the statements that put files under long ones. Its rules
are the sentences of each licence in order, whole or broken off after any of them, with or without "All rights reserved"
before. Where several licences begin alike, what is common to them has the name of the family.

Only texts that hold the two longest words of some known sentence are cut up, which changes no result.

Cases: null and empty texts have no sentence; a licence stated twice is reported once per statement; a text that begins
two rules of one length goes to the licence that the catalogue names first; repeated rows are reported each; a very long
text is read whole, in memory of some ten times its size, if it is cut up; an empty table gives no row;
extra columns of any name are ignored.
"""

from __future__ import annotations

import os.path
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

GAP = 2

# The wording of public licences, sentence by sentence. Marks, case and line ends do not count.
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_NO_CLAIM = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AUTHOR_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)


def _gnu(kind: str, version: str, subject: str, later: bool = True) -> tuple[str, ...]:
    """The statement that puts a program or library under a licence of the GNU family."""
    name = f"GNU {kind}General Public License"
    under = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return (
        f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {under}.",
        f"This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        f"See the {name} for more details.",
        f"You should have received a copy of the {name} along with this {subject}.",
        "If not, see <https://www.gnu.org/licenses/>.",
    )


_CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

LICENCES: dict[str, tuple[str, ...]] = {
    "MIT": (_GRANT + ", subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _AS_IS, _NO_CLAIM),
    "MIT-0": (_GRANT + ".", _AS_IS, _NO_CLAIM),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", *_AUTHOR_AS_IS),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", *_AUTHOR_AS_IS),
    "BSD-2-Clause": (*_BSD, *_BSD_AS_IS),
    "BSD-3-Clause": (*_BSD, _BSD_NAMES, *_BSD_AS_IS),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT.',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        _AS_IS,
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "For more information, please refer to <https://unlicense.org/>",
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "EPL-1.0": ("All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "This license is copied below, and is also available with a FAQ at: https://scripts.sil.org/OFL"),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
        "This software is distributed without any warranty.",
        "You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    ),
    "GPL-2.0-or-later": _gnu("", "2", "program"),
    "GPL-3.0-or-later": _gnu("", "3", "program"),
    "GPL-2.0-only": _gnu("", "2", "program", later=False),
    "GPL-3.0-only": _gnu("", "3", "program", later=False),
    "LGPL-2.1-or-later": _gnu("Lesser ", "2.1", "library"),
    "LGPL-3.0-or-later": _gnu("Lesser ", "3", "library"),
    "AGPL-3.0-or-later": _gnu("Affero ", "3", "program"),
    **{f"CC-{k}-4.0": (f"This work is licensed under the Creative Commons {name} 4.0 International License.", f"To view a copy of this license, visit http://creativecommons.org/licenses/{k.lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.") for k, name in _CREATIVE.items()},
}
#: One-sentence notices, by licence.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD", "Licensed under the BSD License."),
    ("proprietary", "All rights reserved."),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in _CREATIVE),
)
#: Other wordings of sentences above: licence, number of its sentence, the wording.
FORMS = (
    ("MIT", 1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", 2, "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("MIT", 3, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'),
    ("Apache-2.0", 2, "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 2, "You may obtain a copy of the License at"),
    ("BSD-3-Clause", 4, "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", 6, _BSD_AS_IS[1].replace("HOLDER OR", "OWNER OR")),
    ("MPL-2.0", 2, "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0-or-later", 1, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("GPL-2.0-only", 1, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-or-later", 2, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."),
    ("GPL-2.0-or-later", 4, "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("LGPL-2.1-or-later", 4, "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-2.0-or-later", 5, "If not, see <http://www.gnu.org/licenses/>."),
)

_BREAK = re.compile(r"(?<=[.!?:])\s+|\n+")
_MARK = re.compile(r"^[ \t]*(?:@?rem|dnl)[ \t]+", re.I | re.M)  # comment marks that are words
_OTHER = re.compile(r"[\W_]+")


def normal(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def catalogue(licences=LICENCES, notices=NOTICES, forms=FORMS) -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Identifiers by normalised sentence, and rules (licence, identifiers). A sentence of several licences has the identifier of the first."""
    known: dict[str, str] = {}
    named: dict[tuple[str, ...], list[str]] = {}
    for licence, said in licences.items():
        ids = tuple(known.setdefault(normal(s), f"{licence.lower()}-{k}") for k, s in enumerate(said, 1))
        for n in range(1, len(ids) + 1):
            named.setdefault(ids[:n], []).append(licence)
    for k, (licence, said) in enumerate(notices, 1):
        named.setdefault((known.setdefault(normal(said), f"notice-{k}"),), []).append(licence)
    for licence, k, said in forms:
        known.setdefault(normal(said), known[normal(licences[licence][k - 1])])
    reserved = known.get(normal("All rights reserved."))
    whole = {tuple(known[normal(s)] for s in said): licence for licence, said in licences.items()}
    rules = []
    for ids, of in named.items():
        name = whole.get(ids) or (of[0] if len(set(of)) == 1 else os.path.commonprefix(of).rstrip("-.0123456789"))
        rules += [(name or of[0], ids)] + ([(name or of[0], (reserved, *ids))] if reserved and ids[0] != reserved else [])
    return known, sorted(rules, key=lambda r: -len(r[1]))


class Recogniser:
    def __init__(self, licences=LICENCES, notices=NOTICES, forms=FORMS, gap: int = GAP):
        self.known, self.rules = catalogue(licences, notices, forms)
        self.begun: dict[str, list[str]] = {}
        for n in self.known:
            self.begun.setdefault(n.split()[0], []).append(n)
        self.gap = gap
        self.gates = sorted({tuple(sorted(set(n.split()), key=lambda w: (-len(w), w))[:2]) for n in self.known})

    def recognise(self, text: str) -> list[tuple[int, str]]:
        """(number of the sentence, identifier) of each known sentence."""
        low = text.lower()
        if not any(all(w in low for w in g) for g in self.gates):
            return []
        pieces = self.pieces(_MARK.sub("", text))
        out, n, i, running = [], 0, 0, False
        while i < len(pieces):
            found, after = self.longest(pieces, i)
            if found:
                out.append((n, found))
            n += not (running and pieces[i][2] and not found)
            i, running = after, not found
        return out

    @staticmethod
    def pieces(text: str) -> list[tuple[str, bool, bool]]:
        """(normalised, whether no blank line is before it, whether it goes on the sentence before) of each piece."""
        out, at, near, on = [], 0, False, False
        for m in [*_BREAK.finditer(text), None]:
            s = text[at : m.start() if m else len(text)]
            said = normal(s)
            if s.strip():
                out.append((said, near and bool(said), on and bool(said)))
            if m:
                near = bool(said) and m[0].count("\n") < 2
                on = near and text[m.start() - 1] not in ".!?:"
                at = m.end()
        return out

    def longest(self, pieces: list[tuple[str, bool, bool]], i: int) -> tuple[str | None, int]:
        """The longest known sentence that begins with piece i, if any, and the piece after it (or after i)."""
        said = pieces[i][0]
        some = self.begun.get(said.split(" ", 1)[0], [])
        found, after, j = self.known.get(said), i + 1, i + 1
        while j < len(pieces) and pieces[j][1]:
            some = [k for k in some if k.startswith(said + " ")]
            if not some:
                break
            said += " " + pieces[j][0]
            j += 1
            if said in self.known:
                found, after = self.known[said], j
        return found, after

    def match(self, found: list[tuple[int, str]]) -> list[tuple[str, int, int]]:
        """(licence, first sentence, last sentence) of each rule match, by first sentence."""
        free, out = [True] * len(found), []
        there = {f[1] for f in found}
        for licence, wanted in self.rules:
            if not there.issuperset(wanted):
                continue
            for i in range(len(found)):
                if not free[i] or found[i][1] != wanted[0]:
                    continue
                chain = [i]
                for w in wanted[1:]:
                    j = next((j for j in range(chain[-1] + 1, len(found)) if free[j] and found[j][1] == w and found[j][0] - found[chain[-1]][0] <= self.gap + 1), None)
                    if j is None:
                        break
                    chain.append(j)
                if len(chain) == len(wanted):
                    for j in chain:
                        free[j] = False
                    out.append((licence, found[chain[0]][0], found[chain[-1]][0]))
        return sorted(out, key=lambda m: m[1:])


def scan(docs: DataFrame, licences=LICENCES, notices=NOTICES, forms=FORMS, gap: int = GAP) -> DataFrame:
    """Per document: doc_id, n_known (known sentences), sentence_ids, licenses (one per match, in order), matches (licence:first:last)."""
    recogniser = Recogniser(licences, notices, forms, gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.list_(pa.string())
        for batch in batches:
            found = [recogniser.recognise(t.as_py() or "") for t in batch.column(1)]
            matched = [recogniser.match(f) if f else [] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([[i for _, i in f] for f in found], names), pa.array([[m[0] for m in x] for x in matched], names), pa.array([",".join(f"{m}:{a}:{b}" for m, a, b in x) for x in matched], pa.string())],
                ["doc_id", "n_known", "sentence_ids", "licenses", "matches"],
            )

    base = docs.select("doc_id", "text")
    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, n_known long, sentence_ids array<string>, licenses array<string>, matches string")
