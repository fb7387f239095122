"""Licence scans: ordered signature rules, gated by a keyword prefilter, with overlapping detections resolved.

A rule is a regular expression with a priority and a weight. A text's words are looked up in the keyword table first,
so only rules one of whose keywords stands in the text run at all. Of overlapping detections one that lies wholly in
a detection of a higher priority, or in a longer one of the same, is suppressed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowwise import struct_column
from .words import ALPHANUMERIC, hash_word, scan

#: Phrases of consecutive words that are always reported, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Hand-written signatures: label, keywords (one of them is a word of every match), expression of the name.
#: A blank in an expression stands for a short gap without letters or digits. Fixed values.
NAMES = r"""
apache-2.0 | apache | (?:the )?apache (?:software )?licen[cs]e,?(?: version| v)? ?2(?: 0)?|apache 2(?: 0)?(?: licen[cs]e)?|apache (?:software )?licen[cs]e
apache-1.1 | apache | apache (?:software )?licen[cs]e,?(?: version| v)? ?1 1
mit | mit | (?:the )?mit (?:x11 )?licen[cs]e|mit x11
mit-0 | mit | mit no attribution(?: licen[cs]e)?|mit 0
x11 | x11 | x11 licen[cs]e
expat | expat | expat licen[cs]e
isc | isc internet | isc licen[cs]e|internet systems consortium licen[cs]e
bsd-2-clause | bsd simplified freebsd | simplified bsd? licen[cs]e|free ?bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?|2 clause bsd(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?
bsd-4-clause | bsd | (?:original|old) bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?|4 clause bsd(?: licen[cs]e)?
0bsd | 0bsd bsd | 0bsd|zero clause bsd(?: licen[cs]e)?
bsd | bsd | (?:the )?bsd (?:style )?licen[cs]e
gpl-1.0 | general gpl gplv1 | (?:gnu )?general public licen[cs]e,?(?: version| v)? ?1|gpl v? ?1(?: 0)?|gplv1
gpl-2.0 | general gpl gplv2 | (?:gnu )?general public licen[cs]e,?(?: version| v)? ?2|gpl v? ?2(?: 0)?|gplv2
gpl-3.0 | general gpl gplv3 | (?:gnu )?general public licen[cs]e,?(?: version| v)? ?3|gpl v? ?3(?: 0)?|gplv3
lgpl-2.0 | library lgpl | (?:gnu )?library general public licen[cs]e(?:,?(?: version| v)? ?2)?|lgpl v? ?2 0
lgpl-2.1 | lesser lgpl lgplv2 | (?:gnu )?lesser general public licen[cs]e,?(?: version| v)? ?2 1|lgpl v? ?2 1|lgplv2 1
lgpl-3.0 | lesser lgpl lgplv3 | (?:gnu )?lesser general public licen[cs]e,?(?: version| v)? ?3|lgpl v? ?3(?: 0)?|lgplv3
lgpl | lesser lgpl | (?:gnu )?lesser general public licen[cs]e|gnu lgpl
agpl-3.0 | affero agpl agplv3 | (?:gnu )?affero general public licen[cs]e(?:,?(?: version| v)? ?3)?|agpl v? ?3(?: 0)?|agplv3
agpl | affero agpl | (?:gnu )?affero general public licen[cs]e|gnu agpl|agpl licen[cs]e
gpl-any | gpl gnu | gnu gpl|gpl licen[cs]e
gfdl-1.2 | documentation gfdl | (?:gnu )?free documentation licen[cs]e,?(?: version| v)? ?1 2|gfdl v? ?1 2
gfdl-1.3 | documentation gfdl | (?:gnu )?free documentation licen[cs]e,?(?: version| v)? ?1 3|gfdl v? ?1 3
gfdl | documentation gfdl | (?:gnu )?free documentation licen[cs]e
cc-by-2.0 | cc creative | cc by 2 0|creative commons attribution 2 0
cc-by-3.0 | cc creative | cc by 3 0|creative commons attribution 3 0
cc-by-4.0 | cc creative | cc by 4 0|creative commons attribution 4 0
cc-by-sa-3.0 | cc creative | cc by sa 3 0|creative commons attribution share ?alike 3 0
cc-by-sa-4.0 | cc creative | cc by sa 4 0|creative commons attribution share ?alike 4 0
cc-by-sa | cc creative | cc by sa|creative commons attribution share ?alike
cc-by-nc-3.0 | cc creative | cc by nc 3 0|creative commons attribution non ?commercial 3 0
cc-by-nc-4.0 | cc creative | cc by nc 4 0|creative commons attribution non ?commercial 4 0
cc-by-nc | cc creative | cc by nc|creative commons attribution non ?commercial
cc-by-nd-4.0 | cc creative | cc by nd 4 0|creative commons attribution no ?deriv(?:ative)?s 4 0
cc-by-nd | cc creative | cc by nd|creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-sa-4.0 | cc creative | cc by nc sa 4 0|creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-sa | cc creative | cc by nc sa|creative commons attribution non ?commercial share ?alike
cc-by-nc-nd-4.0 | cc creative | cc by nc nd 4 0|creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0
cc-by-nc-nd | cc creative | cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
creative-commons | creative | creative commons(?: public)? licen[cs]e
mpl-1.1 | mozilla mpl | mozilla public licen[cs]e,?(?: version| v)? ?1 1|mpl v? ?1 1
mpl-2.0 | mozilla mpl | mozilla public licen[cs]e,?(?: version| v)? ?2(?: 0)?|mpl v? ?2(?: 0)?
mpl | mozilla | mozilla public licen[cs]e
epl-1.0 | eclipse epl | eclipse public licen[cs]e,?(?: version| v)? ?1(?: 0)?|epl v? ?1(?: 0)?
epl-2.0 | eclipse epl | eclipse public licen[cs]e,?(?: version| v)? ?2(?: 0)?|epl v? ?2(?: 0)?
eupl-1.2 | european eupl | european union public licen[cs]e(?:,?(?: version| v)? ?1 2)?|eupl(?: v? ?1 2)?
cddl-1.0 | common cddl | common development and distribution licen[cs]e|cddl(?: v? ?1 0)?
cpl-1.0 | common cpl | common public licen[cs]e(?:,?(?: version| v)? ?1 0)?|cpl 1 0
cpal-1.0 | common cpal | common public attribution licen[cs]e|cpal 1 0
ms-pl | microsoft ms | microsoft public licen[cs]e|ms pl
ms-rl | microsoft ms | microsoft reciprocal licen[cs]e|ms rl
artistic-1.0 | artistic | artistic licen[cs]e,?(?: version| v)? ?1(?: 0)?
artistic-2.0 | artistic | artistic licen[cs]e,?(?: version| v)? ?2(?: 0)?
artistic | artistic | artistic licen[cs]e
bsl-1.0 | boost bsl | boost software licen[cs]e(?:,?(?: version| v)? ?1 0)?|bsl 1 0
busl-1.1 | business busl | business source licen[cs]e(?:,?(?: version| v)? ?1 1)?|busl 1 1
sspl-1.0 | server sspl | server side public licen[cs]e|sspl(?: v? ?1)?
elastic-2.0 | elastic | elastic licen[cs]e(?:,?(?: version| v)? ?2(?: 0)?)?
zlib | zlib | zlib libpng licen[cs]e|zlib licen[cs]e
libpng | libpng | libpng licen[cs]e
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
beerware | beerware beer | beer ?ware licen[cs]e
openssl | openssl | openssl licen[cs]e
ofl-1.1 | sil ofl | sil open font licen[cs]e(?:,?(?: version| v)? ?1 1)?|ofl 1 1
odbl-1.0 | open odbl | open (?:data commons open )?database licen[cs]e|odbl(?: v? ?1 0)?
odc-by | open odc | open data commons attribution licen[cs]e|odc by(?: 1 0)?
pddl | public pddl | public domain dedication and licen[cs]e|pddl(?: 1 0)?
python-2.0 | python psf | python software foundation licen[cs]e|psf licen[cs]e
php-3.01 | php | php licen[cs]e(?:,?(?: version| v)? ?3 0?1)?
ruby | ruby | ruby licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
w3c | w3c | w3c software (?:notice and )?licen[cs]e
osl-3.0 | open osl | open software licen[cs]e(?:,?(?: version| v)? ?3 0)?|osl 3 0
afl-3.0 | academic afl | academic free licen[cs]e(?:,?(?: version| v)? ?3 0)?|afl 3 0
ecl-2.0 | educational ecl | educational community licen[cs]e(?:,?(?: version| v)? ?2 0)?|ecl 2 0
ncsa | illinois ncsa | university of illinois ncsa(?: open source)? licen[cs]e|ncsa licen[cs]e
vim | vim | vim licen[cs]e
ftl | freetype | freetype (?:project )?licen[cs]e
ijg | jpeg | independent jpeg group licen[cs]e
hpnd | historical | historical permission notice and disclaimer
cecill-2.1 | cecill cecill2 | cecill(?: licen[cs]e)?(?:,?(?: version| v)? ?2 1)?
qpl-1.0 | qpl q qpublic | q ?public licen[cs]e|qpl 1 0
openrail | openrail rail | (?:bigscience )?open ?rail(?: m)? licen[cs]e
"""

#: Notices that name no licence: label, keywords, expression. Fixed values.
NOTICES = r"""
copyright | copyright | copyright(?: c| ©)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | copyright | (?:© |\(c\) )copyright
public-domain | public | (?:released|placed|dedicated|is) (?:in)?to? ?the public domain|in the public domain
no-warranty | warranty warranties warrantie | without warranty of any kind|without any warranty|no warranties? of any kind|provided as is without (?:express or implied )?warranty
proprietary | proprietary confidential | proprietary and confidential|confidential and proprietary
redistribution | redistribution | redistribution and use in source and binary forms
permission-grant | permission | permission is hereby granted,? free of charge
permission-reserved | permission reproduced | (?:used|reprinted|reproduced) (?:with|by) permission|no part of this (?:publication|work|book) may be reproduced
gpl-or-later | option | (?:either version [0-9] of the licen[cs]e or )?at your option any later version
gpl-warranty | implied | without even the implied warranty of merchantability or fitness for a particular purpose
gpl-received | received | you should have received a copy of the gnu (?:lesser |affero |library )?general public licen[cs]e
gpl-program | redistribute | (?:this program|this library|it) is free software,? you can redistribute it and or modify it
mit-grant | sublicense | to use,? copy,? modify,? merge,? publish,? distribute,? sublicense,? and or sell copies
mit-notice | notice | the above copyright notice and this permission notice shall be included in all copies
bsd-conditions | retain | redistributions of source code must retain the above copyright notice
bsd-binary | reproduce | redistributions in binary form must reproduce the above copyright notice
bsd-endorse | endorse | (?:may not|nor) (?:be used to )?endorse or promote products derived from this software
bsd-advertising | advertising | all advertising materials mentioning features or use of this software
isc-grant | permission | permission to use,? copy,? modify,? and or distribute this software for any purpose
zlib-origin | misrepresented | the origin of this software must not be misrepresented
apache-notice | compliance | you may not use this file except in compliance with the licen[cs]e
apache-copy | obtain | you may obtain a copy of the licen[cs]e at
apache-as-is | basis | distributed on an as is basis
liability | liable | in no event shall the (?:authors?|copyright holders?|regents?)(?: or contributors| or copyright holders)? be (?:held )?liable
mpl-header | subject | this source code form is subject to the terms of the mozilla public licen[cs]e
unlicense-text | unencumbered | this is free and unencumbered software released into the public domain
wtfpl-text | want | do what the (?:fuck|heck) you want to public licen[cs]e
no-rights | reserved | no rights reserved|some rights reserved
reserved-fr | réservés reserves | tous droits r[ée]serv[ée]s
reserved-de | vorbehalten | alle rechte vorbehalten
reserved-es | reservados | todos los derechos reservados
terms | terms | subject to the terms (?:and conditions )?of
"""

#: How names are met: label suffix is none; expression around the name, priority and weight.
FRAMES = (
    (r"spdx licen[cs]e identifier {}", 0, 0.95),
    (r"(?:(?:dual )?licen[cs]ed|released|distributed|available|published|provided|made available) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:{})", 1, 0.9),
    (r"(?:under|see) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:{})", 2, 0.8),
    (r"(?:{})", 3, 0.6),
)
NOTICE_PRIORITY, NOTICE_WEIGHT, BASE_WEIGHT = 4, 0.3, 0.5
GAP = r"[^a-z0-9\x80-\U0010ffff]{1,4}"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    expression: str
    keywords: tuple[str, ...]

    @cached_property
    def find(self) -> re.Pattern:
        """Compiled when first needed; most rules' keywords never occur."""
        return _compile(self.expression)


def _compile(expression: str) -> re.Pattern:
    body = expression.replace(" ?", f"(?:{GAP})?").replace(" ", GAP)
    return re.compile(rf"(?<![a-z0-9\x80-\U0010ffff])(?:{body})(?![a-z0-9\x80-\U0010ffff])")


@cache
def rules() -> tuple[Rule, ...]:
    """Every name in every frame, then the notices; the order breaks ties."""
    rows = [tuple(x.strip() for x in line.split("|", 2)) for line in NAMES.strip().splitlines()]
    out = []
    for frame, priority, weight in FRAMES:
        for label, keywords, name in rows:
            if priority == 0:
                out.append(Rule(label, priority, weight, frame.format(re.escape(label).replace(r"\-", " ").replace(r"\.", " ")), ("spdx",)))
            else:
                out.append(Rule(label, priority, weight, frame.format(name), tuple(keywords.split())))
    for line in NOTICES.strip().splitlines():
        label, keywords, expression = (x.strip() for x in line.split("|", 2))
        out.append(Rule(label, NOTICE_PRIORITY, NOTICE_WEIGHT, expression, tuple(keywords.split())))
    return tuple(out)


@cache
def _by_keyword() -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Sorted hashes of keywords, and the rules of each."""
    by = defaultdict(list)
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            by[int(hash_word(word, ALPHANUMERIC))].append(i)
    keys = sorted(by)
    return np.array(keys, np.uint64), [tuple(by[k]) for k in keys]


def suppress(found: list[tuple[int, int, int]], priority: list[int]) -> list[int]:
    """Places in found (start, end, rule) that stay. Equal spans of one priority: the first rule stays."""
    order = sorted(range(len(found)), key=lambda i: (priority[found[i][2]], found[i][0], -found[i][1], found[i][2]))
    kept: list[int] = []
    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(order):
        level, fresh, reach = priority[found[order[at]][2]], [], -1
        while at < len(order) and priority[found[order[at]][2]] == level:
            s, e, _ = found[order[at]]
            k = int(np.searchsorted(starts, s, "right")) - 1
            if e > reach and not (k >= 0 and ends[k] >= e):
                fresh.append(order[at])
                reach = e
            at += 1
        kept += fresh
        own = sorted(found[i][:2] for i in kept)
        starts = np.array([s for s, _ in own], np.int64)
        ends = np.maximum.accumulate(np.array([e for _, e in own], np.int64)) if own else starts
    return sorted(kept)


def _lower(text: bytes) -> str:
    return text.translate(_LOWER).decode()


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def scan_text(text: str, candidates: list[int]) -> list[tuple[int, int, int]]:
    """Detections (start, end, rule) of these rules in lower-case text that stay."""
    found = [(m.start(), m.end(), i) for i in candidates for m in rules()[i].find.finditer(text)]
    return [found[k] for k in suppress(found, [r.priority for r in rules()])]


RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,priority:int>>"


def _work(texts: list[bytes | None]) -> list:
    words = scan(texts, ALPHANUMERIC)
    h, first = words.hashes, words.first
    n_base, base = np.zeros(len(texts), np.int64), [set() for _ in texts]
    low, high = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), -1)
    for phrase, label in BASE:
        parts = [hash_word(w, ALPHANUMERIC) for w in phrase.split()]
        at = np.flatnonzero(h == parts[0])
        for k, part in enumerate(parts[1:], 1):
            at = at[at + k < len(h)]
            at = at[h[at + k] == part]
        text = np.searchsorted(first, at, "right") - 1
        inside = at + len(parts) <= first[text + 1]
        at, text = at[inside], text[inside]
        np.add.at(n_base, text, 1)
        np.minimum.at(low, text, at - first[text])
        np.maximum.at(high, text, at - first[text])
        for i in np.unique(text).tolist():
            base[i].add(label)
    keys, gated = _by_keyword()
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = np.flatnonzero(keys[place] == h)
    which = np.unique((np.searchsorted(first, hit, "right") - 1) * len(keys) + place[hit])
    run: dict[int, set[int]] = defaultdict(set)
    for i, k in zip((which // len(keys)).tolist(), (which % len(keys)).tolist()):
        run[i].update(gated[k])
    labels, scores, spans = [], [], []
    for i, t in enumerate(texts):
        found = scan_text(_lower(t), sorted(run[i])) if i in run else []
        weight = {label: BASE_WEIGHT for label in base[i]}
        for _, _, k in found:
            rule = rules()[k]
            weight[rule.label] = max(weight.get(rule.label, 0.0), rule.weight)
        labels.append(",".join(sorted(weight)))
        scores.append(1.0 - float(np.prod([1.0 - w for _, w in sorted(weight.items())])))
        spans.append([{"start": s, "end": e, "label": rules()[k].label, "priority": rules()[k].priority} for s, e, k in found])
    some = n_base > 0
    return [words.counts(), n_base, pa.array(low, mask=~some), pa.array(high, mask=~some), [",".join(sorted(b)) for b in base], labels, scores, spans]


def scanned(text: Column) -> Column:
    """A struct column as in RESULT. A null text counts as empty: no words, no labels, score 0."""
    return struct_column(_work, RESULT, text)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of RESULT for every row of docs; detections are character spans of the whole text."""
    return docs.select("doc_id", scanned(F.col("text")).alias("_r")).select("doc_id", "_r.*")
