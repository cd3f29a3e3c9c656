"""License scans: ordered signature rules, gated by keywords, with priorities and containment suppression.

The rules are hundreds of regular expressions: sentences of license texts and headers (grants, conditions, warranty
lines), and a table of license families (names, versions, addresses) with, in order of priority, the ways in which
notices state a family. A rule runs only on texts that hold its literals, which every match of it holds.
Detections are taken in order of priority and then length; one whose interval lies inside a taken one is
suppressed."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash as wh
from .spans import Held

# fixed values: the base phrases and their labels
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# fixed values: license families as (SPDX stem, keywords, name pattern, versions, address); a match of the name holds all
# words of one of the keywords
FAMILIES = (
    ("MIT", "mit", r"mit", ("",), "opensource.org/licenses/mit"),
    ("Apache", "apache", r"apache(?: software)?", ("2.0", "1.1", "1.0"), "apache.org/licenses/license-"),
    ("GPL", "general public", r"(?:gnu )?general public", ("3.0", "2.0", "1.0"), "gnu.org/licenses/gpl"),
    ("LGPL", "lesser", r"(?:gnu )?lesser general public", ("3.0", "2.1", "2.0"), "gnu.org/licenses/lgpl"),
    ("AGPL", "affero", r"(?:gnu )?affero general public", ("3.0", "1.0"), "gnu.org/licenses/agpl"),
    ("GFDL", "free documentation", r"(?:gnu )?free documentation", ("1.3", "1.2", "1.1"), "gnu.org/licenses/fdl"),
    ("BSD-2-Clause", "bsd", r"(?:bsd[ -]2[ -]clause|simplified bsd)", ("",), "opensource.org/licenses/bsd-2-clause"),
    ("BSD-3-Clause", "bsd", r"(?:bsd[ -]3[ -]clause|(?:new|modified) bsd)", ("",), "opensource.org/licenses/bsd-3-clause"),
    ("MPL", "mozilla", r"mozilla public", ("2.0", "1.1", "1.0"), "mozilla.org/mpl/"),
    ("EPL", "eclipse", r"eclipse public", ("2.0", "1.0"), "eclipse.org/legal/epl-"),
    ("CDDL", "common development", r"common development and distribution", ("1.1", "1.0"), "opensource.org/licenses/cddl"),
    ("CC-BY", "cc|creative commons", r"(?:creative commons attribution|cc[ -]by)(?![ -](?:n|s))", ("4.0", "3.0", "2.5", "2.0"), "creativecommons.org/licenses/by/"),
    ("CC-BY-SA", "cc|creative commons", r"(?:creative commons attribution[ -]share ?alike|cc[ -]by[ -]sa)", ("4.0", "3.0", "2.5", "2.0"), "creativecommons.org/licenses/by-sa/"),
    ("CC-BY-NC", "cc|creative commons", r"(?:creative commons attribution[ -]non ?commercial|cc[ -]by[ -]nc)(?![ -](?:n|s))", ("4.0", "3.0", "2.5", "2.0"), "creativecommons.org/licenses/by-nc/"),
    ("CC-BY-ND", "cc|creative commons", r"(?:creative commons attribution[ -]no ?derivatives|cc[ -]by[ -]nd)", ("4.0", "3.0", "2.5", "2.0"), "creativecommons.org/licenses/by-nd/"),
    ("CC-BY-NC-SA", "cc|creative commons", r"(?:creative commons attribution[ -]non ?commercial[ -]share ?alike|cc[ -]by[ -]nc[ -]sa)", ("4.0", "3.0", "2.5", "2.0"), "creativecommons.org/licenses/by-nc-sa/"),
    ("CC-BY-NC-ND", "cc|creative commons", r"(?:creative commons attribution[ -]non ?commercial[ -]no ?derivatives|cc[ -]by[ -]nc[ -]nd)", ("4.0", "3.0", "2.5", "2.0"), "creativecommons.org/licenses/by-nc-nd/"),
    ("CC0", "cc0", r"cc0", ("1.0",), "creativecommons.org/publicdomain/zero/"),
    ("ISC", "isc", r"isc", ("",), "opensource.org/licenses/isc"),
    ("Unlicense", "unlicense", r"unlicense", ("",), "unlicense.org"),
    ("Zlib", "zlib", r"zlib(?:/libpng)?", ("",), "opensource.org/licenses/zlib"),
    ("BSL", "boost", r"boost software", ("1.0",), "boost.org/license_"),
    ("Artistic", "artistic", r"artistic", ("2.0", "1.0"), "opensource.org/licenses/artistic-"),
    ("OFL", "open font", r"(?:sil )?open font", ("1.1", "1.0"), "scripts.sil.org/ofl"),
    ("EUPL", "european union public", r"european union public", ("1.2", "1.1"), "eupl.eu/"),
    ("WTFPL", "wtfpl", r"wtfpl", ("2",), "wtfpl.net"),
    ("PSF", "python software foundation", r"python software foundation", ("2",), "python.org/psf/license"),
    ("PostgreSQL", "postgresql", r"postgresql", ("",), "opensource.org/licenses/postgresql"),
    ("OpenSSL", "openssl", r"openssl", ("",), "openssl.org/source/license"),
    ("MS-PL", "microsoft", r"microsoft public", ("",), "opensource.org/licenses/ms-pl"),
    ("MS-RL", "microsoft", r"microsoft reciprocal", ("",), "opensource.org/licenses/ms-rl"),
    ("NCSA", "illinois", r"university of illinois(?:/ncsa)? open source", ("",), "opensource.org/licenses/ncsa"),
    ("AFL", "academic free", r"academic free", ("3.0", "2.1"), "opensource.org/licenses/afl-"),
    ("OSL", "open software", r"open software", ("3.0", "2.1"), "opensource.org/licenses/osl-"),
    ("ODbL", "database", r"open database", ("1.0",), "opendatacommons.org/licenses/odbl"),
    ("ODC-By", "open data commons", r"open data commons attribution", ("1.0",), "opendatacommons.org/licenses/by"),
    ("PDDL", "public domain dedication", r"public domain dedication and", ("1.0",), "opendatacommons.org/licenses/pddl"),
    ("LPPL", "latex", r"latex project public", ("1.3c", "1.3a", "1.2"), "latex-project.org/lppl"),
    ("RPL", "reciprocal public", r"reciprocal public", ("1.5", "1.1"), "opensource.org/licenses/rpl-"),
    ("SSPL", "server side public", r"server side public", ("1.0",), "mongodb.com/licensing/server-side-public-license"),
    ("BUSL", "business source", r"business source", ("1.1",), "mariadb.com/bsl"),
    ("Elastic", "elastic", r"elastic", ("2.0",), "elastic.co/licensing/elastic-license"),
    ("ECL", "educational community", r"educational community", ("2.0", "1.0"), "opensource.org/licenses/ecl"),
    ("UPL", "universal permissive", r"universal permissive", ("1.0",), "oss.oracle.com/licenses/upl"),
    ("Vim", "vim", r"vim", ("",), "vimhelp.org/uganda"),
    ("W3C", "w3c", r"w3c software(?: notice and)?", ("",), "w3.org/consortium/legal"),
)

# fixed values: sentences of license texts and of the headers of files: label, confidence, words. Between words any space
# and punctuation may stand, as in comments; a * stands for up to twelve words
SENTENCES = (
    ("MIT", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", 0.8, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MIT", 0.7, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("MIT", 0.7, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("MIT", 0.85, "licensed under the expat license"),
    ("MIT-0", 0.9, "mit no attribution"),
    ("X11", 0.85, "except as contained in this notice the name of * shall not be used in advertising or otherwise to promote the sale"),
    ("Apache-2.0", 1.0, "licensed under the apache license version 2 0 the license"),
    ("Apache-2.0", 0.9, "you may not use this file except in compliance with the license"),
    ("Apache-2.0", 0.8, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("Apache-2.0", 0.9, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("Apache-2.0", 0.9, "terms and conditions for use reproduction and distribution"),
    ("Apache-1.1", 0.9, "this product includes software developed by the apache software foundation"),
    ("GPL-3.0-or-later", 1.0, "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL-2.0-or-later", 1.0, "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL-2.0-only", 0.95, "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("GPL-3.0-only", 0.95, "under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("GPL", 0.7, "this program is free software you can redistribute it and or modify"),
    ("GPL", 0.7, "see the gnu general public license for more details"),
    ("GPL", 0.7, "you should have received a copy of the gnu general public license along with this program"),
    ("GPL", 0.5, "either version * of the license or at your option any later version"),
    ("LGPL-2.1-or-later", 1.0, "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("LGPL-3.0-or-later", 1.0, "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("LGPL-2.0-or-later", 1.0, "gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("LGPL", 0.7, "see the gnu lesser general public license for more details"),
    ("LGPL", 0.7, "gnu library general public license"),
    ("AGPL-3.0-or-later", 1.0, "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("AGPL", 0.7, "see the gnu affero general public license for more details"),
    ("GFDL", 0.9, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("BSD", 0.8, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD", 0.7, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD", 0.7, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD-3-Clause", 0.9, "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("BSD-4-Clause", 0.95, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSD", 0.7, "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("BSD", 0.7, "this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("BSD", 0.6, "use of this source code is governed by a bsd style license"),
    ("ISC", 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", 0.7, "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("0BSD", 0.9, "bsd zero clause license"),
    ("Zlib", 0.7, "this software is provided as is without any express or implied warranty"),
    ("Zlib", 0.9, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("Zlib", 0.9, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("BSL-1.0", 0.95, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("BSL-1.0", 0.95, "distributed under the boost software license version 1 0"),
    ("MPL-2.0", 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPL-2.0", 0.9, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("MPL-1.1", 1.0, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("EPL", 0.9, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("CDDL", 0.9, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("Unlicense", 0.95, "this is free and unencumbered software released into the public domain"),
    ("Unlicense", 0.9, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("CC0-1.0", 0.9, "to the extent possible under law * has waived all copyright and related or neighboring rights"),
    ("CC", 0.7, "this work is licensed under a creative commons"),
    ("CC", 0.6, "some rights reserved under creative commons"),
    ("OFL-1.1", 0.95, "this font software is licensed under the sil open font license version 1 1"),
    ("OFL", 0.8, "reserved font name"),
    ("Artistic", 0.9, "the intent of this document is to state the conditions under which a package may be copied"),
    ("Perl", 0.9, "under the same terms as perl itself"),
    ("PSF", 0.9, "psf license agreement for python"),
    ("PostgreSQL", 0.9, "this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("OpenSSL", 0.9, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("SSLeay", 0.9, "this product includes cryptographic software written by eric young"),
    ("libpng", 0.9, "this copy of the libpng notices is provided for your convenience"),
    ("curl", 0.8, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("LPPL", 0.9, "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("EUPL", 0.9, "licensed under the eupl"),
    ("Ruby", 0.9, "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("Vim", 0.8, "vim is charityware"),
    ("NCSA", 0.8, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("Beerware", 0.95, "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("JSON", 0.95, "the software shall be used for good not evil"),
    ("WTFPL", 0.95, "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("Commons-Clause", 0.95, "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("Elastic-2.0", 0.95, "you may not provide the software to third parties as a hosted or managed service"),
    ("BUSL-1.1", 0.8, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("SSPL-1.0", 0.95, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("MS-PL", 0.8, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("proprietary", 0.7, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 0.6, "proprietary and confidential"),
    ("proprietary", 0.6, "confidential and proprietary"),
    ("proprietary", 0.5, "no part of this publication may be reproduced distributed or transmitted in any form"),
    ("proprietary", 0.5, "end user license agreement"),
    ("proprietary", 0.4, "may not be reproduced without permission"),
)


def _sentence(words: str) -> tuple[str, tuple[str, ...]]:
    """Pattern of a sentence, and its longest words as literals of its gate."""
    between, word = r"[\W_]{1,20}", r"[^\W_]+"  # disjoint, so a * can be tried in one way only
    parts = [rf"{word}(?:{between}{word}){{0,11}}?" if w == "*" else re.escape(w) for w in words.split()]
    return rf"(?<!\w){between.join(parts)}(?!\w)", tuple(sorted({w for w in words.split() if w != "*"}, key=lambda w: (-len(w), w))[:3])


@cache
def rules() -> tuple[tuple[str, tuple[tuple[str, ...], ...], int, float, re.Pattern], ...]:
    """(label, gate, priority, confidence, pattern) in order of priority, for lower-cased text. Every match holds all
    literals of one of the gate's alternatives."""
    out = []
    for label, sure, words in SENTENCES:
        pattern, literals = _sentence(words)
        out.append((label, (literals,), 1, sure, pattern))
    for stem, key, name, versions, address in FAMILIES:
        low = re.escape(stem.lower())
        licence = r"\s+licen[cs]e"
        name_ = name.replace("[ -]", r"(?:\s+|-)").replace(" ?", r"\s*").replace(" ", r"\s+")
        named = lambda *more: tuple((*k.split(), *more) for k in key.split("|"))
        for v in versions:
            label = f"{stem}-{v}" if v else stem
            # 3.0 is also written 3
            number = re.escape(v[:-2]) + r"(?:\.0)?" if v.endswith(".0") else re.escape(v)
            digits = v.removesuffix(".0")
            if v:
                out += [
                    (label, (("spdx-license-identifier", stem.lower(), digits),), 1, 1.0, rf"spdx-license-identifier:\s*{low}-{number}(?:-only|-or-later)?(?![\w.-])"),
                    (label, named(digits), 2, 0.95, rf"(?<!\w){name_}(?:{licence})?,?\s+(?:version\s+|v\.?\s*)?{number}(?![\w]|\.\d)"),
                    (label, ((address, digits),), 3, 0.9, rf"{re.escape(address)}\W?{number}(?![\w]|\.\d)"),
                    (label, ((stem.lower(), digits),), 4, 0.8, rf"(?<![\w-]){low}[- ]?v?{number}(?:\+|-only|-or-later)?(?![\w-]|\.\d)"),
                ]
            else:
                out += [
                    (label, (("spdx-license-identifier", stem.lower()),), 1, 1.0, rf"spdx-license-identifier:\s*{low}(?![\w.-])"),
                    (label, ((address,),), 3, 0.9, rf"{re.escape(address)}(?![\w-])"),
                ]
        out += [
            (stem, named("licen"), 5, 0.75, rf"(?:under|by|of|with)\s+(?:the\s+)?(?:terms\s+of\s+the\s+)?{name_}{licence}"),
            (stem, named("licen"), 6, 0.6, rf"(?<!\w){name_}{licence}"),
        ]
    out += [
        ("proprietary", (("reserved", "rights"),), 7, 0.4, r"all\s+rights\s+reserved"),
        ("copyright-notice", (("copyright",),), 8, 0.3, r"copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d"),
        ("public-domain", (("domain", "public"),), 7, 0.5, r"(?:released\s+)?in(?:to)?\s+the\s+public\s+domain"),
        ("licensed", (("licen", "under"),), 9, 0.2, r"licen[cs]ed\s+under\s+\S+"),
    ]
    return tuple((a, k, p, c, re.compile(x)) for a, k, p, c, x in sorted(out, key=lambda r: r[2]))


@cache
def _gates() -> dict[str, tuple[tuple[tuple[str, ...], int], ...]]:
    """The rules by a literal of theirs, each with its other literals."""
    out: dict[str, list] = {}
    for i, r in enumerate(rules()):
        for first, *more in r[1]:
            out.setdefault(first, []).append((tuple(more), i))
    return {k: tuple(v) for k, v in out.items()}


def candidates(text: str) -> list[int]:
    """The rules whose literals the text holds, in order."""
    return sorted({i for first, at in _gates().items() if first in text for more, i in at if all(x in text for x in more)})


def lowered(text: str) -> str:
    """A-Z lower-cased and nothing else, so that positions stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def detections(text: str) -> list[tuple[str, int, int, float]]:
    """(label, start, end, confidence) of the detections that stand, by start. text: A-Z lower-cased."""
    found = []
    for i in candidates(text):
        label, _, priority, sure, pattern = rules()[i]
        found += [(priority, m.start() - m.end(), m.start(), m.end(), label, sure) for m in pattern.finditer(text)]
    taken, out = Held(), []
    for _, _, i, j, label, sure in sorted(found):
        if taken.covers(i, j):
            continue
        out.append((label, i, j, sure))
        taken.add(i, j)
    return sorted(out, key=lambda d: (d[1], d[2], d[0]))


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BASE_WORDS = tuple((tuple(p.split()), label) for p, label in BASE)


def base_places(text: str) -> list[tuple[int, str]]:
    """(word index, label) of each place where a base phrase's words stand consecutively. text: A-Z lower-cased."""
    if not any(p[-1] in text for p, _ in _BASE_WORDS):
        return []
    w = _WORD.findall(text)
    at = [i for i, x in enumerate(w) if x == "license"]
    return sorted((i - len(p) + 1, label) for i in at for p, label in _BASE_WORDS if i + 1 >= len(p) and tuple(w[i - len(p) + 1 : i + 1]) == p)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:int,end:int,confidence:double>>"


def _scan(batches):
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))
    for b in batches:
        col = b.column("text")
        n_words = []
        for i, j in wh.chunks(col):
            part = col.slice(i, j - i)
            n_words += wh.count_words(part, wh.ALNUM_LOWER).tolist()
        rows = []
        for text in col.to_pylist():
            low = lowered(text or "")
            base, found = base_places(low), detections(low)
            first = sorted({x for _, x in base})
            labels = sorted({*first, *(d[0] for d in found)})
            score = 1.0
            for d in found:
                score *= 1 - d[3]
            score = 1 - score if found else 0.5 * bool(base)
            rows.append((len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(first), ",".join(labels), score, [dict(zip(("label", "start", "end", "confidence"), d)) for d in found]))
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), kind]
        names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_words", *names])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word and last_word (null without a base phrase),
    base_labels, labels, score (0 to 1: one minus the product of the detections' doubts) and the detections that
    stand (label, code-point interval, confidence). Null texts are empty; null ids stay null; repeated rows give
    equal rows."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(common.in_batches, _scan, _SCHEMA)
