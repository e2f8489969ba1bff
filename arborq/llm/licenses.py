"""License scans by sentence rules (operator 7).

Comment marks are taken off the lines of a text, and it is cut at line feeds and sentence ends. A known sentence of a
licence is found where its words, whatever the line feeds among them, begin and end at such cuts; at each place the longest
one. The sequence of known identifiers is matched against ordered rules, from left to right: at each place the longest
rule that fits the identifiers ahead wins, of equally long ones the first. Unknown sentences may stand between two known
ones, up to `gap`. SPDX lines name their licences themselves.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.llm import common

#: Sentences of licences and notices, by identifier. <> stands for a name of up to MOST_NAME words.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-name": "Released under the MIT License.",
    "mit-name-2": "Licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-name": "Licensed under the Apache License, Version 2.0.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-name": "This work is licensed under the GNU General Public License, version 3.",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
    "mit-notice-2": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd-endorse-2": "Neither the name of <> nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-3": "The name of <> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-4": "Neither the names of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "apache-copy-2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-3": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-title": "Apache License Version 2.0, January 2004",
    "gpl-apply": "If you develop a new program, and you want it to be of the greatest possible use to the public, the best way to achieve this is to make it free software which everyone can redistribute and change under these terms.",
    "lgpl-apply": "If you develop a new library, and you want it to be of the greatest possible use to the public, we recommend making it free software that everyone can redistribute and change.",
    "gpl1-title": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "lgpl2-title": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gfdl12-title": "GNU Free Documentation License Version 1.2, November 2002",
    "gfdl13-title": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl2-name": "This work is licensed under the GNU General Public License, version 2.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-waiver": "To the extent possible under law, <> has waived all copyright and related or neighboring rights to <>.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-name": "Distributed under the Boost Software License, Version 1.0.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-title": "Eclipse Public License - v 2.0",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "artistic-title": "The \"Artistic License\"",
}
#: Licence, work, name and version of the grants of the GNU family, each as "or later" and as "only".
GNU = [
    (f"{short}-{v if '.' in v else v + '.0'}", work, name, v)
    for short, name, versions in (("GPL", "GNU General Public License", "23"), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("LGPL", "GNU Library General Public License", "2"), ("AGPL", "GNU Affero General Public License", "3"))
    for v in versions
    for work in ("program", "library", "software", "file")
]
#: Creative Commons names by the letters of their licences.
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Sentences that the two tables above make: text to (identifier, licence).
MADE: dict[str, tuple[str, str]] = {}
for _id, _work, _name, _v in GNU:
    for _be in (f"This {_work} is free software", "<> is free software"):
        _grant = f"{_be}: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation, "
        MADE[f"{_grant}either version {_v} of the License, or (at your option) any later version."] = (f"{_id.lower()}-later", f"{_id}-or-later")
        MADE[f"{_grant}either version {_v}, or (at your option) any later version."] = (f"{_id.lower()}-later", f"{_id}-or-later")
        MADE[f"{_grant}version {_v} of the License."] = (f"{_id.lower()}-only", f"{_id}-only")
        MADE[f"{_grant}version {_v}."] = (f"{_id.lower()}-only", f"{_id}-only")
for _letters, _name in CREATIVE.items():
    for _v in ("4.0 International", "3.0 Unported"):
        _id = f"CC-{_letters}-{_v[:3]}"
        for _by in ("This work is licensed under", "This work is licensed under a", "This work is licensed under the", "Licensed under", "Licensed under a", "Licensed under the"):
            MADE |= {f"{_by} Creative Commons {_name} {_v} License.": (_id.lower(), _id), f"{_by} CC {_letters} {_v[:3]}.": (_id.lower(), _id)}
for _by in ("Licensed under", "Licensed under the", "Released under", "Released under the", "Distributed under the", "This project is licensed under the", "This software is licensed under the", "This work is licensed under the"):
    for _name, _id in (("MIT License", "MIT"), ("ISC License", "ISC"), ("Apache License, Version 2.0", "Apache-2.0"), ("Apache License 2.0", "Apache-2.0"), ("BSD 2-Clause License", "BSD-2-Clause"), ("BSD 3-Clause License", "BSD-3-Clause"), ("Mozilla Public License 2.0", "MPL-2.0"), ("GNU General Public License v2.0", "GPL-2.0-only"), ("GNU General Public License v3.0", "GPL-3.0-only"), ("GNU Lesser General Public License v2.1", "LGPL-2.1-only"), ("GNU Lesser General Public License v3.0", "LGPL-3.0-only"), ("GNU Affero General Public License v3.0", "AGPL-3.0-only")):
        MADE[f"{_by} {_name}."] = (f"name-{_id.lower()}", _id)
#: Licence and the identifiers that show it, in the order in which rules are tried among equally long ones.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-name-2",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-head", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-head", "apache-use")),
    ("Apache-2.0", ("apache-name",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl-name",)),
    ("MPL-2.0", ("mpl-terms",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("reserved",)),
    ("MIT", ("mit-grant", "mit-notice-2")),
    ("MIT-0", ("mit0-grant",)),
    ("ISC", ("isc-grant-2",)),
    ("0BSD", ("0bsd-grant",)),
    *[("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", f"bsd-endorse-{k}")) for k in (2, 3, 4)],
    *[("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", f"bsd-endorse{k}")) for k in ("", "-2", "-3", "-4")],
    *[("Apache-2.0", ("apache-head", "apache-use", f"apache-copy-{k}")) for k in (2, 3)],
    ("Apache-2.0", ("apache-title",)),
    *[(name, (f"{k}-title",)) for name, k in (("GPL-1.0-only", "gpl1"), ("GFDL-1.2-only", "gfdl12"), ("GFDL-1.3-only", "gfdl13"), ("LGPL-2.0-only", "lgpl2"), ("GPL-2.0-only", "gpl2"), ("GPL-3.0-only", "gpl3"), ("LGPL-2.1-only", "lgpl21"), ("LGPL-3.0-only", "lgpl3"), ("AGPL-3.0-only", "agpl3"))],
    # the model notice at the end of a full text grants nothing
    *[("", ("gpl-apply", x)) for x in ("gpl-free", "gpl-2.0-later", "agpl-3.0-later")],
    *[("", ("lgpl-apply", x)) for x in ("lgpl-2.0-later", "lgpl-2.1-later")],
    ("GPL-2.0-only", ("gpl2-name",)),
    ("MPL-2.0", ("mpl-terms", "mpl-copy")),
    ("MPL-2.0", ("mpl-title",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    *[("BSL-1.0", (x,)) for x in ("bsl-title", "bsl-grant", "bsl-name")],
    *[("EPL-2.0", (x,)) for x in ("epl2-terms", "epl2-title")],
    ("WTFPL", ("wtfpl-title",)),
    ("Artistic-1.0", ("artistic-title",)),
    *[(name, (k,)) for k, name in dict(MADE.values()).items()],
)
#: "All rights reserved" above one of these belongs to it.
RULES += tuple((name, ("reserved", *rule)) for name, rule in RULES if rule[0] in ("bsd-grant", "mit-grant", "mit0-grant", "isc-grant", "isc-grant-2", "apache-head"))
#: Where a known sentence may begin and end: punctuation before white space, and line feeds.
CUTS = re.compile(r"(?<=[.;:!?])\s+|[^\S\n]*\n\s*")
#: Marks of comments, quotations and lists in front of a line's text.
MARKS = re.compile(r"""^[^\S\n]*(?:(?:[#*>|;%!'"]+|/[/*]+!?|\*+/|--+|<!--|\.\\"|(?:REM|rem|dnl)\b|C(?=[ \t]{2})|\(?(?:\d{1,2}|[a-z]|[ivx]{2,4})\)(?=[ \t]))[^\S\n]*)+""", re.M)
WORDS = re.compile(r"[a-z0-9]+")
MOST_NAME = 12
#: An SPDX line and its expression; old names and what they mean now.
SPDX_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\+?"
SPDX_ONE = rf"\(*[ \t]*{SPDX_ID}(?:[ \t]+(?:WITH|with)[ \t]+{SPDX_ID})?(?:[ \t]*\))*"
SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*({SPDX_ONE}(?:[ \t]+(?:AND|OR|and|or)[ \t]+{SPDX_ONE})*)")
OLD_IDS = {f"{x}{end}": f"{x}-{now}" for x in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end, now in (("", "only"), ("+", "or-later"))}


def normalised(sentence: str) -> str:
    return " ".join(WORDS.findall(sentence.lower()))


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier; a name's place stays <>."""
    every = [*((s, k) for k, s in SENTENCES.items()), *((s, k) for s, (k, _) in MADE.items())]
    out: dict[str, str] = {}
    for s, k in every:
        out.setdefault(" <> ".join(normalised(x) for x in s.split("<>")).strip(), k)
    return out


def spdx_names(expression: str) -> list[str]:
    """The licences of an SPDX expression, without the exceptions behind WITH."""
    words = [w for w in re.findall(rf"{SPDX_ID}", expression)]
    names = [w for k, w in enumerate(words) if w.upper() not in ("AND", "OR", "WITH") and not (k and words[k - 1].upper() == "WITH")]
    return [OLD_IDS.get(w, w) for w in names]


class Recogniser:
    def __init__(self, gap: int = 8):
        self.known, self.gap = known_sentences(), gap
        #: Words to what may follow; "" holds the identifier of a sentence that ends there, None what follows a name.
        self.tree: dict = {}
        for sentence, name in self.known.items():
            node = self.tree
            for word in sentence.split():
                node = node.setdefault(None if word == "<>" else word, {})
            node[""] = name
        self.rules: dict[str, list] = {}
        for name, rule in RULES:
            self.rules.setdefault(rule[0], []).append((name, rule))
        #: A text without any of these words has no known sentence.
        self.hint = re.compile("licen[sc]e|permission|permitted|copyright|redistribut|neither|warranty|rights|unencumbered|advertising|endorse|universal|under cc|MPL|new (?:program|library)", re.I)

    def reach(self, node: dict, words: list[str], at: int, ends: set[int]) -> tuple[int, str] | None:
        """The furthest of ends to which a known sentence leads from node on, and its identifier; of sentences that lead
        equally far, words go before a name."""
        best = None
        while True:
            if "" in node and at in ends and (best is None or at >= best[0]):
                best = at, node[""]
            if None in node:
                for k in range(at + 1, min(at + MOST_NAME, len(words)) + 1):
                    far = self.reach(node[None], words, k, ends) if k in ends or k < len(words) and words[k] in node[None] else None
                    if far and (best is None or far[0] > best[0]):
                        best = far
                    if node is self.tree and k in ends:  # a name in front does not take in the line above
                        break
            if at == len(words) or words[at] not in node:
                return best
            node, at = node[words[at]], at + 1

    def identifiers(self, text: str) -> list[tuple[int, int, str]]:
        """(number of the first sentence, of the last one, identifier) of known sentences and SPDX licences.

        Sentences are counted at punctuation, at empty lines, and at a line feed before anything but a lower-case letter.
        """
        if not self.hint.search(text):
            return []
        text = MARKS.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
        pieces, words, at, number = [], [], 0, 0  # pieces: first word, sentence, place in text
        for cut in [*CUTS.finditer(text), None]:
            end = cut.start() if cut else len(text)
            own = WORDS.findall(text[at:end].lower())
            if own:
                pieces.append((len(words), number, at))
                words += own
            if cut:
                at = cut.end()
                inner = cut[0].count("\n") == 1 and text[end - 1 : end] not in tuple(".;:!?") and "a" <= text[at : at + 1] <= "z"
                number += not inner
        starts = [p[0] for p in pieces]
        ends, place = {*starts[1:], len(words)}, {w: k for k, w in enumerate(starts)}
        place[len(words)] = len(pieces)
        found, k = [], 0
        while k < len(pieces):
            far = self.reach(self.tree, words, starts[k], ends)
            if far:
                n = place[far[0]]
                found.append((pieces[k][1], pieces[n - 1][1], far[1], pieces[k][2]))
                k = n
            else:
                k += 1
        if "SPDX-License-Identifier" in text:
            for m in SPDX.finditer(text):
                where = bisect.bisect_right([p[2] for p in pieces], m.start()) - 1
                found += [(pieces[where][1], pieces[where][1], f"spdx:{x}", m.start()) for x in spdx_names(m[1])]
            found.sort(key=lambda x: x[3])
        return [x[:3] for x in found]

    def licences(self, found: list[tuple[int, int, str]]) -> list[str]:
        """The licence of each match, in order."""
        out, k = [], 0
        while k < len(found):
            best = None
            if found[k][2].startswith("spdx:"):
                best = found[k][2][5:], 1
            for name, rule in self.rules.get(found[k][2], ()):
                ahead = found[k : k + len(rule)]
                near = all(b[0] - a[1] <= self.gap + 1 for a, b in zip(ahead, ahead[1:], strict=False))
                if tuple(x[2] for x in ahead) == rule and near and (best is None or len(rule) > best[1]):
                    best = name, len(rule)
            if best and best[0]:
                out.append(best[0])
            k += best[1] if best else 1
        return out


OUT = pa.schema([("doc_id", pa.int64()), ("n_known", pa.int64()), ("sentence_ids", pa.string()), ("licenses", pa.string())])


def scan_licenses(docs: DataFrame, gap: int = 8) -> DataFrame:
    """Each document of docs (doc_id, text): known sentences in order, and the distinct licences shown, sorted.

    Null and empty texts show none. Repeated rows stay repeated, null doc_ids are kept, other columns are ignored, an
    empty table gives an empty result. No shuffle.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Recogniser(gap)

        def rows():
            for batch in batches:
                for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = r.identifiers(text) if text else []
                    yield d, len(found), ",".join(x for _, _, x in found), ",".join(sorted(set(r.licences(found))))

        yield from common.rows_out(rows(), OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scanned, "doc_id long, n_known long, sentence_ids string, licenses string")


def op7_license_sentences(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    return scan_licenses(common.table(spark, sf_dir, "documents"))
