"""License detection by ordered signature rules.

A rule is (label, priority, keyword, pattern).  An Aho-Corasick automaton over all
keywords runs once over a text; only rules whose keyword occurs are tried.  Matches are
taken in order of priority (exact identifiers before full texts before references), then
length, then place; a match whose interval lies inside that of an earlier accepted one is
suppressed, so "GNU General Public License version 2" does not report "GNU General Public
License" as well.

Beside the rules stand three base phrases of whole words; their labels are always kept.

The score is the chance that at least one label is right, by how sure each label's best
match is.  Null and empty texts have no words, no labels and score 0; repeated rows give
repeated results; an empty table gives an empty table; only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from commlens.llm.common import lower_az, map_batches, texts

#: Base phrases: words in a row, and their label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# label: (SPDX identifiers, name patterns).  In names a space stands for any run of white
# space, comment leaders and punctuation that line wrapping may bring, hyphens included;
# so none may stand in brackets.
_NAMES = {
    "mit": (["MIT", "MIT-0", "X11"], ["mit licen[sc]e", "x11 licen[sc]e", "expat licen[sc]e"]),
    "apache-2": (["Apache-2.0"], ["apache (?:software )?licen[sc]e,? (?:version|v\\.?) ?2(?:\\.0)?", "apache-2(?:\\.0)?", "apache licen[sc]e 2(?:\\.0)?"]),
    "apache-1.1": (["Apache-1.1"], ["apache (?:software )?licen[sc]e,? (?:version|v\\.?) ?1\\.1"]),
    "bsd-2-clause": (["BSD-2-Clause", "BSD-2-Clause-Patent"], ["2-clause bsd", "bsd 2-clause", "simplified bsd licen[sc]e", "freebsd licen[sc]e"]),
    "bsd-3-clause": (["BSD-3-Clause", "BSD-3-Clause-Clear"], ["3-clause bsd", "bsd 3-clause", "new bsd licen[sc]e", "modified bsd licen[sc]e"]),
    "bsd-4-clause": (["BSD-4-Clause"], ["4-clause bsd", "bsd 4-clause", "original bsd licen[sc]e"]),
    "0bsd": (["0BSD"], ["zero-clause bsd", "bsd zero clause"]),
    "isc": (["ISC"], ["isc licen[sc]e"]),
    "gpl-1": (["GPL-1.0-only", "GPL-1.0-or-later", "GPL-1.0"], ["gnu general public licen[sc]e,? (?:version|v\\.?) ?1(?:\\.0)?", "gplv1"]),
    "gpl-2": (["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-2.0+"], ["gnu general public licen[sc]e,? (?:version|v\\.?) ?2(?:\\.0)?", "gnu gpl (?:version |v\\.?) ?2", "gplv2", "gpl-2"]),
    "gpl-3": (["GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0", "GPL-3.0+"], ["gnu general public licen[sc]e,? (?:version|v\\.?) ?3(?:\\.0)?", "gnu gpl (?:version |v\\.?) ?3", "gplv3", "gpl-3"]),
    "gpl": ([], ["gnu general public licen[sc]e", "gnu gpl"]),
    "lgpl-2": (["LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.0"], ["gnu library general public licen[sc]e", "lgplv2"]),
    "lgpl-2.1": (["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1"], ["gnu lesser general public licen[sc]e,? (?:version|v\\.?) ?2\\.1", "lgplv2\\.1", "lgpl-2\\.1"]),
    "lgpl-3": (["LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0"], ["gnu lesser general public licen[sc]e,? (?:version|v\\.?) ?3", "lgplv3", "lgpl-3"]),
    "lgpl": ([], ["gnu lesser general public licen[sc]e", "gnu lgpl"]),
    "agpl-3": (["AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"], ["gnu affero general public licen[sc]e(?:,? (?:version|v\\.?) ?3)?", "agplv3", "agpl-3"]),
    "gfdl": (["GFDL-1.1-only", "GFDL-1.2-only", "GFDL-1.3-only", "GFDL-1.3-or-later"], ["gnu free documentation licen[sc]e", "gfdl"]),
    "mpl-1.1": (["MPL-1.0", "MPL-1.1"], ["mozilla public licen[sc]e,? (?:version|v\\.?) ?1\\.[01]"]),
    "mpl-2": (["MPL-2.0"], ["mozilla public licen[sc]e,? (?:version|v\\.?) ?2(?:\\.0)?", "mpl-2\\.0"]),
    "epl-1": (["EPL-1.0"], ["eclipse public licen[sc]e,?(?: -)? (?:version|v\\.?) ?1(?:\\.0)?"]),
    "epl-2": (["EPL-2.0"], ["eclipse public licen[sc]e,?(?: -)? (?:version|v\\.?) ?2(?:\\.0)?"]),
    "cddl-1": (["CDDL-1.0", "CDDL-1.1"], ["common development and distribution licen[sc]e"]),
    "cpl-1": (["CPL-1.0"], ["common public licen[sc]e"]),
    "artistic-1": (["Artistic-1.0", "Artistic-1.0-Perl"], ["artistic licen[sc]e 1(?:\\.0)?", "perl artistic licen[sc]e"]),
    "artistic-2": (["Artistic-2.0"], ["artistic licen[sc]e,? (?:version )?2(?:\\.0)?"]),
    "zlib": (["Zlib", "zlib-acknowledgement"], ["zlib licen[sc]e", "zlib/libpng licen[sc]e"]),
    "libpng": (["Libpng", "libpng-2.0"], ["libpng licen[sc]e"]),
    "boost-1": (["BSL-1.0"], ["boost software licen[sc]e"]),
    "unlicense": (["Unlicense"], ["the unlicen[sc]e", "released into the public domain", "unlicense\\.org"]),
    "wtfpl": (["WTFPL"], ["do what the f\\w+ you want to public licen[sc]e", "wtfpl"]),
    "cc0-1": (["CC0-1.0"], ["cc0(?: 1\\.0)?(?: universal)?", "creative commons zero", "publicdomain/zero/1\\.0"]),
    "cc-by": (["CC-BY-1.0", "CC-BY-2.0", "CC-BY-2.5", "CC-BY-3.0", "CC-BY-4.0"], ["creative commons attribution (?:[234]\\.[05] )?(?:international|unported|generic)", "creativecommons\\.org/licenses/by/[1-4]\\.[05]"]),
    "cc-by-sa": (["CC-BY-SA-1.0", "CC-BY-SA-2.0", "CC-BY-SA-2.5", "CC-BY-SA-3.0", "CC-BY-SA-4.0"], ["creative commons attribution-share ?alike", "creativecommons\\.org/licenses/by-sa/[1-4]\\.[05]", "cc by sa"]),
    "cc-by-nd": (["CC-BY-ND-2.0", "CC-BY-ND-3.0", "CC-BY-ND-4.0"], ["creative commons attribution-no ?deriv\\w*", "creativecommons\\.org/licenses/by-nd/[1-4]\\.[05]", "cc by nd"]),
    "cc-by-nc": (["CC-BY-NC-1.0", "CC-BY-NC-2.0", "CC-BY-NC-2.5", "CC-BY-NC-3.0", "CC-BY-NC-4.0"], ["creative commons attribution-non ?commercial", "creativecommons\\.org/licenses/by-nc/[1-4]\\.[05]", "cc by nc"]),
    "cc-by-nc-sa": (["CC-BY-NC-SA-2.0", "CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0"], ["creative commons attribution-non ?commercial-share ?alike", "creativecommons\\.org/licenses/by-nc-sa/[1-4]\\.[05]", "cc by nc sa"]),
    "cc-by-nc-nd": (["CC-BY-NC-ND-2.0", "CC-BY-NC-ND-3.0", "CC-BY-NC-ND-4.0"], ["creative commons attribution-non ?commercial-no ?deriv\\w*", "creativecommons\\.org/licenses/by-nc-nd/[1-4]\\.[05]", "cc by nc nd"]),
    "ofl-1.1": (["OFL-1.0", "OFL-1.1"], ["sil open font licen[sc]e", "open font licen[sc]e"]),
    "python-2": (["Python-2.0", "PSF-2.0"], ["python software foundation licen[sc]e", "psf licen[sc]e"]),
    "ruby": (["Ruby"], ["ruby licen[sc]e", "same terms as ruby"]),
    "php-3": (["PHP-3.0", "PHP-3.01"], ["php licen[sc]e,? (?:version|v\\.?) ?3"]),
    "openssl": (["OpenSSL"], ["openssl licen[sc]e"]),
    "postgresql": (["PostgreSQL"], ["postgresql licen[sc]e"]),
    "ncsa": (["NCSA"], ["university of illinois/ncsa open source licen[sc]e", "ncsa open source licen[sc]e"]),
    "w3c": (["W3C", "W3C-20150513"], ["w3c software (?:notice and )?licen[sc]e"]),
    "ms-pl": (["MS-PL"], ["microsoft public licen[sc]e"]),
    "ms-rl": (["MS-RL"], ["microsoft reciprocal licen[sc]e"]),
    "eupl": (["EUPL-1.1", "EUPL-1.2"], ["european union public licen[sc]e"]),
    "cecill": (["CECILL-2.0", "CECILL-2.1", "CECILL-B", "CECILL-C"], ["cecill(?:-[bc])? (?:free software )?licen[sc]e"]),
    "osl-3": (["OSL-3.0"], ["open software licen[sc]e,? (?:version|v\\.?) ?3"]),
    "afl-3": (["AFL-3.0"], ["academic free licen[sc]e"]),
    "upl-1": (["UPL-1.0"], ["universal permissive licen[sc]e"]),
    "sspl-1": (["SSPL-1.0"], ["server side public licen[sc]e"]),
    "busl-1.1": (["BUSL-1.1"], ["business source licen[sc]e"]),
    "elastic-2": (["Elastic-2.0"], ["elastic licen[sc]e"]),
    "odbl-1": (["ODbL-1.0"], ["open (?:data commons open )?database licen[sc]e"]),
    "odc-by": (["ODC-By-1.0"], ["open data commons attribution"]),
    "pddl-1": (["PDDL-1.0"], ["public domain dedication (?:and|&) licen[sc]e"]),
    "vim": (["Vim"], ["vim licen[sc]e"]),
    "curl": (["curl"], ["curl licen[sc]e"]),
    "tcl": (["TCL"], ["tcl/tk licen[sc]e"]),
    "unicode": (["Unicode-DFS-2016", "Unicode-3.0"], ["unicode,? inc\\.? licen[sc]e"]),
    "beerware": (["Beerware"], ["the beer-?ware licen[sc]e"]),
    "json": (["JSON"], ["shall be used for good,? not evil"]),
    "bigscience-rail": (["BigScience-BLOOM-RAIL-1.0"], ["bigscience (?:bloom )?rail", "open rail-?m? licen[sc]e"]),
    "proprietary": ([], ["all rights reserved", "proprietary and confidential", "confidential and proprietary"]),
}

# label: sentences of the licence text itself
_TEXTS = {
    "mit": ["permission is hereby granted, free of charge, to any person obtaining a copy", "the above copyright notice and this permission notice shall be included in all"],
    "isc": ["permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"],
    "bsd-2-clause": ["redistributions in binary form must reproduce the above copyright notice"],
    "bsd-3-clause": ["neither the name of .{1,80}? nor the names of its contributors may be used"],
    "bsd-4-clause": ["all advertising materials mentioning features or use of this software must display"],
    "apache-2": ["licensed under the apache license, version 2\\.0", "you may not use this file except in compliance with the license"],
    "gpl": ["this program is free software[;:] you can redistribute it and/or modify"],
    "lgpl": ["this library is free software[;:] you can redistribute it and/or modify"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license, v\\. 2\\.0"],
    "zlib": ["this software is provided 'as-is', without any express or implied warranty", "altered source versions must be plainly marked as such"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "boost-1": ["permission is hereby granted, free of charge, to any person or organization obtaining a copy"],
    "cc0-1": ["waived all copyright and related or neighboring rights"],
    "ofl-1.1": ["this font software is licensed under the sil open font license"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license"],
}

# label: more sentences of licence texts and notices, without their punctuation (a space
# stands for that as well)
_NOTICES = {
    "mit": ["the software is provided as is without warranty of any kind express or implied", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "to deal in the software without restriction including without limitation the rights"],
    "isc": ["the software is provided as is and the author disclaims all warranties with regard to this software"],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"],
    "bsd": ["redistributions of source code must retain the above copyright notice", "this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? as is and any express or implied warranties"],
    "bsd-4-clause": ["this product includes software developed by the university of california"],
    "apache-2": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "see the license for the specific language governing permissions and limitations", "each contributor hereby grants to you a perpetual worldwide", "www\\.apache\\.org/licenses/license-2\\.0"],
    "apache-1.1": ["this product includes software developed by the apache software foundation"],
    "gpl": ["this program is distributed in the hope that it will be useful but without any warranty", "you should have received a copy of the gnu general public licen[sc]e", "www\\.gnu\\.org/licenses/gpl"],
    "gpl-2": ["either version 2 of the licen[sc]e or at your option any later version", "the licenses for most software are designed to take away your freedom to share and change it"],
    "gpl-3": ["either version 3 of the licen[sc]e or at your option any later version", "the gnu general public license is a free copyleft license for software and other kinds of works"],
    "lgpl": ["you should have received a copy of the gnu lesser general public licen[sc]e", "www\\.gnu\\.org/licenses/lgpl"],
    "lgpl-2.1": ["either version 2\\.1 of the licen[sc]e or at your option any later version"],
    "lgpl-3": ["this version of the gnu lesser general public license incorporates the terms and conditions of version 3"],
    "agpl-3": ["you should have received a copy of the gnu affero general public licen[sc]e", "interacting with it remotely through a computer network"],
    "gfdl": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"],
    "mpl-2": ["if a copy of the mpl was not distributed with this file you can obtain one", "incompatible with secondary licenses as defined by the mozilla public"],
    "mpl-1.1": ["the contents of this file are subject to the mozilla public license version 1\\.1"],
    "epl-1": ["the accompanying program is provided under the terms of this eclipse public license"],
    "cddl-1": ["the contents of this file are subject to the terms of the common development and distribution"],
    "cpl-1": ["the accompanying program is provided under the terms of this common public license"],
    "artistic-1": ["the package is provided as is and without any express or implied warranties including without limitation the implied warranties of merchantibility"],
    "artistic-2": ["this license establishes the terms under which a given free software package may be copied modified distributed"],
    "zlib": ["this notice may not be removed or altered from any source distribution", "in no event will the authors be held liable for any damages arising from the use of this software"],
    "boost-1": ["distributed under the boost software license version 1\\.0", "www\\.boost\\.org/license_1_0\\.txt"],
    "unlicense": ["anyone is free to copy modify publish use compile sell or distribute this software"],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "cc0-1": ["the person who associated a work with this deed has dedicated the work to the public domain"],
    "cc-by": ["this work is licensed under a creative commons attribution (?:[234]\\.[05] )?(?:international |unported |generic )?licen[sc]e"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution share ?alike"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution non ?commercial (?:[234]\\.[05] )?(?:international |unported |generic )?licen[sc]e"],
    "ofl-1.1": ["the font software may be bundled redistributed and or sold with any software", "reserved font name"],
    "python-2": ["psf is making python available to licensee on an as is basis", "psf hereby grants licensee a nonexclusive royalty-free"],
    "php-3": ["this product includes php software freely available from"],
    "openssl": ["this product includes software developed by the openssl project for use in the openssl toolkit"],
    "postgresql": ["this software and its documentation for any purpose without fee and without a written agreement is hereby granted"],
    "ncsa": ["to deal with the software without restriction including without limitation the rights"],
    "w3c": ["by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"],
    "ms-pl": ["this license governs use of the accompanying software if you use the software you accept this license"],
    "eupl": ["licensed under the eupl", "european union public licence v\\. 1\\.[12]"],
    "cecill": ["this software is governed by the cecill"],
    "sspl-1": ["offering the program as a service to third parties"],
    "busl-1.1": ["grants you the right to copy modify create derivative works redistribute and make non-production use of the licensed work"],
    "elastic-2": ["you may not provide the software to third parties as a hosted or managed service"],
    "odbl-1": ["made available under the open database licen[sc]e"],
    "odc-by": ["made available under the open data commons attribution"],
    "pddl-1": ["public domain dedication and licen[sc]e", "open data commons pddl"],
    "llama": ["llama 2 community licen[sc]e", "llama 3(?:\\.[0-9])? community licen[sc]e", "meta llama (?:[23] )?is licensed under"],
    "gemma": ["gemma terms of use"],
    "commons-clause": ["commons clause licen[sc]e condition", "the license does not grant to you the right to sell the software"],
    "polyform": ["polyform noncommercial licen[sc]e", "polyform small business licen[sc]e", "polyform shield licen[sc]e", "polyform perimeter licen[sc]e"],
    "hippocratic": ["hippocratic licen[sc]e"],
    "mulan": ["mulan permissive software licen[sc]e"],
    "vim": ["vim licen[sc]e"],
    "nasa": ["nasa open source agreement"],
    "ipl-1": ["ibm public licen[sc]e"],
    "lucent": ["lucent public licen[sc]e"],
    "sun": ["sun public licen[sc]e", "sun industry standards source licen[sc]e"],
    "apsl": ["apple public source licen[sc]e"],
    "qpl": ["q public licen[sc]e"],
    "sleepycat": ["sleepycat licen[sc]e"],
    "watcom": ["sybase open watcom public licen[sc]e"],
    "zpl": ["zope public licen[sc]e"],
    "icu": ["icu licen[sc]e"],
    "ijg": ["this software is based in part on the work of the independent jpeg group"],
    "ftl": ["freetype project licen[sc]e", "portions of this software are copyright \\w+ the freetype project"],
    "lppl": ["latex project public licen[sc]e"],
    "bitstream-vera": ["bitstream vera fonts copyright"],
    "ogl": ["open government licen[sc]e", "contains public sector information licensed under"],
    "public-domain": ["this work is in the public domain", "dedicated to the public domain", "not subject to copyright protection (?:and is )?in the united states"],
    "proprietary": ["unauthorized copying of this file via any medium is strictly prohibited", "may not be reproduced distributed or transmitted in any form without (?:the )?prior written permission", "this software is the confidential and proprietary information of", "the software is licensed not sold", "by installing or using the software you agree to (?:be bound by )?the terms of this (?:end user )?licen[sc]e agreement"],
}

#: What may stand between two words of a phrase.
_GAP = r"[\s\p{P}\p{S}]{1,12}"


def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(r"(?<![\p{L}\p{N}])(?:" + pattern.replace(" ?", "\0").replace(" ", _GAP).replace("\0", r"\s?") + r")(?![\p{L}\p{N}])", regex.S)


def _keyword(pattern: str) -> str:
    """The longest run of plain characters that every match must hold."""
    bare = regex.sub(r"\((?:[^()]|\([^()]*\))*\)[?*+]?|\[[^\]]*\][?*+]?|\\.|.[?*]|[.+{}]", "\0", pattern)
    return max(regex.split(r"[\0 ,;:'&|/-]+", bare), key=len)


@lru_cache(maxsize=1)
def rules() -> tuple[list[tuple[str, int, regex.Pattern]], ahocorasick.Automaton]:
    """The rules in order, and the automaton from keyword to rule numbers."""
    out: list[tuple[str, int, regex.Pattern]] = []
    by_word: dict[str, list[int]] = {}

    def add(label: str, priority: int, keyword: str, pattern: str) -> None:
        by_word.setdefault(keyword, []).append(len(out))
        out.append((label, priority, _compiled(pattern)))

    for label, (ids, names) in _NAMES.items():
        for i in ids:
            add(label, 0, "spdx-license-identifier", rf"spdx-license-identifier:\s*\(?{regex.escape(i.lower())}(?![\w.+-])")
            add(label, 1, i.lower(), rf"licen[sc]e[sd]?[\"']?\s*[:=]\s*[\"'\[(]*{regex.escape(i.lower())}(?![\w.+-])")
        for n in names:
            add(label, 3, _keyword(n), n)
    for label, sentences in [*_TEXTS.items(), *_NOTICES.items()]:
        for s in sentences:
            add(label, 2, _keyword(s), s)
    automaton = ahocorasick.Automaton()
    for word, numbers in by_word.items():
        automaton.add_word(word, numbers)
    automaton.make_automaton()
    return out, automaton


def detect(text: str) -> list[tuple[str, int, int, int]]:
    """(label, begin, end, priority) of the accepted matches of the rules, in the order of the text."""
    table, automaton = rules()
    low = text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    tried = {k for _, numbers in automaton.iter(low) for k in numbers}
    found = [(table[k][1], m.start() - m.end(), m.start(), m.end(), table[k][0]) for k in sorted(tried) for m in table[k][2].finditer(low)]
    kept: list[tuple[str, int, int, int]] = []
    # the accepted intervals that lie in no other one: both begins and ends ascend
    begins: list[int] = []
    ends: list[int] = []
    for priority, _, a, b, label in sorted(found):
        at = bisect_right(begins, a)
        if at and ends[at - 1] >= b:
            continue
        kept.append((label, a, b, priority))
        first, last = bisect_left(begins, a), bisect_right(ends, b)
        begins[first:last], ends[first:last] = [a], [b]
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


_NON_WORD = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BYTES = [(p.encode(), label) for p, label in PHRASES.items()]
#: How sure a match is, by priority; a base phrase counts as a reference by name.
_SURE = {0: 0.98, 1: 0.9, 2: 0.9, 3: 0.7}


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """The contract columns of one text."""
    data = lower_az(text.encode("utf-8", "surrogatepass")).translate(_NON_WORD)
    inside = np.frombuffer(b" " + data, dtype=np.uint8) != 32
    n_words = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    sure: dict[str, float] = {}
    n_base, first, last = 0, None, None
    joined = None
    for phrase, label in _BYTES:
        if not all(w in data for w in phrase.split()):
            continue
        joined = joined if joined is not None else b" " + regex.sub(rb" +", b" ", data.strip(b" ")) + b" "
        at, before, word = joined.find(b" " + phrase + b" "), 0, -1
        while at >= 0:
            word += joined.count(b" ", before, at + 1)
            before = at + 1
            n_base += 1
            first, last = word if first is None else min(first, word), word if last is None else max(last, word)
            sure[label] = _SURE[3]
            at = joined.find(b" " + phrase + b" ", before)
    base = ",".join(sorted(sure))
    for label, _, _, priority in detect(text):
        sure[label] = max(sure.get(label, 0.0), _SURE[priority])
    # the chance that at least one label is right
    score = 1.0 - float(np.prod([1.0 - x for x in sure.values()])) if sure else 0.0
    return n_words, n_base, first, last, base, ",".join(sorted(sure)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: words, base phrases and labels."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*[scan(t) for t in texts(b)], strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)
