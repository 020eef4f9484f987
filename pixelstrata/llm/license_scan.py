"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text is lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; rules are regular expressions over the
words joined by one space, matched at whole words. A rule runs only where its keyword stands in the raw text, so most
texts are settled by a handful of substring searches. Each match is an interval with the rule's priority; an interval
inside another goes if the other's priority is higher, or equal and the interval longer. The survivors give labels and
the score (the best survivor's weight).

Three kinds of rules, in a fixed order: names of families in FORMS (grant, notice, tag, title); SPDX identifiers and short
names (MARKS) behind "SPDX-License-Identifier:", behind "License:" or "licensed under", and alone where they are distinct; and signature
sentences of license bodies (BODIES). A rule with a group counts as the group's interval. Base phrases are exact and always count: n_base places, their first and last word.

Defined cases: null, empty and wordless texts have 0 words and no labels; whole texts of any length are scanned;
repeated rows and null doc_ids return their rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernels import blocks, spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label, keyword, pattern of the family's name over normalised words.
FAMILIES = (
    ("agpl-1", "affero", r"affero general public license (?:version |v )?1(?: 0)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public license,? (?:version |v )?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("gpl-1", "general public", r"(?:gnu )?general public license (?:version |v )?1(?: 0)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public license (?:as published by the free software foundation )?(?:version |v )?2(?: 0)?"),
    ("gpl-3", "general public", r"(?:gnu )?general public license (?:as published by the free software foundation )?(?:version |v )?3(?: 0)?"),
    ("gpl", "general public", r"gnu general public license"),
    ("gpl-2-tag", "gpl", r"gpl (?:v ?)?2(?: 0)?(?: only| or later)?"),
    ("gpl-3-tag", "gpl", r"gpl (?:v ?)?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2", "library general", r"(?:gnu )?library general public license(?: version 2(?: 0)?)?"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license (?:version |v )?2 1"),
    ("lgpl-3", "lesser general", r"(?:gnu )?lesser general public license (?:version |v )?3(?: 0)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public license"),
    ("apache-1", "apache", r"apache (?:software )?license (?:version )?1(?: [01])?"),
    ("apache-2", "apache", r"apache (?:software )?license (?:version |v )?2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?license"),
    ("mit", "mit", r"mit license"),
    ("mit-x11", "x11", r"(?:mit )?x11 license"),
    ("bsd-0", "bsd", r"(?:0|zero) clause bsd license"),
    ("bsd-2", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd) license"),
    ("bsd-3", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd) license"),
    ("bsd-4", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd) license"),
    ("bsd", "bsd", r"bsd(?: style)? license"),
    ("isc", "isc", r"isc license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("mpl-1", "mozilla", r"mozilla public license (?:version |v )?1(?: [01])?"),
    ("mpl-2", "mozilla", r"mozilla public license (?:version |v )?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1", "eclipse", r"eclipse public license (?:version |v )?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license (?:version |v )?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("cddl-1", "common development", r"common development and distribution license(?: version)?(?: 1(?: [01])?)?"),
    ("eupl", "european union", r"european union public licen[cs]e(?: (?:version |v )?1(?: [012])?)?"),
    ("artistic-1", "artistic", r"artistic license (?:version |v )?1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic license (?:version |v )?2(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("boost", "boost", r"boost software license(?: (?:version |v )?1(?: 0)?)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "want to public", r"do what the f\w* you want to public license"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "attribution", r"attribution noncommercial noderivs?(?:atives)?(?: [1234] [05])?"),
    ("cc-by-nc-sa", "attribution", r"attribution noncommercial sharealike(?: [1234] [05])?"),
    ("cc-by-nc-long", "attribution", r"attribution non ?commercial(?: [1234] [05])?"),
    ("cc-by-sa-long", "attribution", r"attribution share ?alike(?: [1234] [05])?"),
    ("cc-by-nd-long", "attribution", r"attribution no ?deriv(?:s|atives)(?: [1234] [05])?"),
    ("cc-by-long", "attribution", r"creative commons attribution(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?"),
    ("cc-by", "cc", r"cc by(?: [1234] [05])?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license(?: (?:version |v )?1(?: [123])?)?"),
    ("odbl", "open database", r"open database license"),
    ("odc-by", "open data commons", r"open data commons attribution license"),
    ("pddl", "public domain dedication", r"public domain dedication and license"),
    ("ofl", "open font", r"(?:sil )?open font license"),
    ("psf", "python software", r"python software foundation license"),
    ("ms-pl", "microsoft public", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("openssl", "openssl", r"openssl license"),
    ("php", "php", r"php license(?: version 3(?: 0)?)?"),
    ("sspl", "server side", r"server side public license"),
    ("bsl", "business source", r"business source license(?: 1 1)?"),
    ("elastic", "elastic", r"elastic license(?: 2(?: 0)?)?"),
    ("public-domain", "public domain", r"public domain"),
    ("all-rights-reserved", "all rights", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary(?: and confidential| license)?"),
)
#: Name, priority, weight, and the words around a family's name.
FORMS = (
    ("grant", 4, 1.0, r"(?:this (?:work|file|text|software|program|document|content) is )?(?:licensed|released|distributed|available|provided|published|redistributed) under (?:the (?:terms of )?(?:the )?)?{}"),
    ("notice", 3, 0.9, r"under (?:the (?:terms (?:and conditions )?of )?(?:the )?)?{}"),
    ("tag", 3, 0.9, r"(?:spdx license identifier|licen[cs]e) {}"),
    ("title", 2, 0.6, r"{}"),
)


#: Label, keyword, pattern of the identifier or short name, and where it counts: "spdx" behind an SPDX tag only,
#: "tag" also behind "license" or "licensed under", "bare" also alone.
MARKS = (
    ("mit", "mit", r"mit", "tag"),
    ("mit-0", "mit", r"mit 0", "tag"),
    ("mit-x11", "x11", r"x11", "tag"),
    ("apache", "apache", r"apache", "tag"),
    ("apache-1", "apache", r"apache ?v? ?1 [01]", "tag"),
    ("apache-2", "apache", r"apache ?v? ?2 0", "bare"),
    ("apache-2", "apache", r"apache ?v? ?2", "tag"),
    ("apache-2", "asl", r"asl ?v? ?2(?: 0)?", "tag"),
    ("bsd", "bsd", r"bsd", "tag"),
    ("bsd-0", "0bsd", r"0bsd", "bare"),
    ("bsd-1", "bsd", r"bsd 1 clause", "bare"),
    ("bsd-2", "bsd", r"bsd 2(?: clause)?(?: patent| views)?", "tag"),
    ("bsd-2", "bsd", r"bsd 2 clause", "bare"),
    ("bsd-3", "bsd", r"bsd 3(?: clause)?(?: clear| lbnl)?", "tag"),
    ("bsd-3", "bsd", r"bsd 3 clause", "bare"),
    ("bsd-4", "bsd", r"bsd 4(?: clause)?(?: uc)?", "tag"),
    ("bsd-4", "bsd", r"bsd 4 clause", "bare"),
    ("gpl", "gpl", r"gpl", "tag"),
    ("gpl-1", "gpl", r"gpl ?v? ?1(?: 0)?(?: only| or later)?", "bare"),
    ("gpl-2", "gpl", r"gpl ?v? ?2(?: 0)?(?: only| or later)?", "bare"),
    ("gpl-3", "gpl", r"gpl ?v? ?3(?: 0)?(?: only| or later)?", "bare"),
    ("lgpl", "lgpl", r"lgpl", "tag"),
    ("lgpl-2", "lgpl", r"lgpl ?v? ?2(?: 0)?(?: only| or later)?", "bare"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v? ?2 1(?: only| or later)?", "bare"),
    ("lgpl-3", "lgpl", r"lgpl ?v? ?3(?: 0)?(?: only| or later)?", "bare"),
    ("agpl", "agpl", r"agpl", "tag"),
    ("agpl-1", "agpl", r"agpl ?v? ?1(?: 0)?(?: only| or later)?", "bare"),
    ("agpl-3", "agpl", r"agpl ?v? ?3(?: 0)?(?: only| or later)?", "bare"),
    ("gfdl", "gfdl", r"gfdl(?: ?v? ?1 [123])?(?: only| or later| (?:no )?invariants(?: only| or later))?", "tag"),
    ("gfdl", "gfdl", r"gfdl ?v? ?1 [123]", "bare"),
    ("isc", "isc", r"isc", "tag"),
    ("zlib", "zlib", r"zlib(?: acknowledgement)?", "tag"),
    ("mpl", "mpl", r"mpl", "tag"),
    ("mpl-1", "mpl", r"mpl ?v? ?1 [01]", "bare"),
    ("mpl-2", "mpl", r"mpl ?v? ?2 0(?: no copyleft exception)?", "bare"),
    ("mpl-2", "mpl", r"mpl ?v? ?2", "tag"),
    ("epl", "epl", r"epl", "tag"),
    ("epl-1", "epl", r"epl ?v? ?1 0", "bare"),
    ("epl-2", "epl", r"epl ?v? ?2 0", "bare"),
    ("cpl-1", "cpl", r"cpl 1 0", "tag"),
    ("cddl-1", "cddl", r"cddl(?: ?v? ?1 [01])?", "tag"),
    ("cddl-1", "cddl", r"cddl ?v? ?1 [01]", "bare"),
    ("eupl", "eupl", r"eupl(?: ?v? ?1 [012])?", "tag"),
    ("eupl", "eupl", r"eupl ?v? ?1 [012]", "bare"),
    ("cecill", "cecill", r"cecill(?: [12] [01]| b| c)?", "bare"),
    ("artistic-1", "artistic", r"artistic 1 0(?: cl8| perl)?", "tag"),
    ("artistic-2", "artistic", r"artistic 2 0", "tag"),
    ("afl", "afl", r"afl [123] [012]", "tag"),
    ("osl", "osl", r"osl [123] [01]", "tag"),
    ("ecl", "ecl", r"ecl [12] 0", "tag"),
    ("upl", "upl", r"upl 1 0", "tag"),
    ("apsl", "apsl", r"apsl [12] [012]", "tag"),
    ("lppl", "lppl", r"lppl 1 [0123][ac]?", "tag"),
    ("zpl", "zpl", r"zpl [12] [01]", "tag"),
    ("mulan", "mulanpsl", r"mulanpsl [12] 0", "bare"),
    ("blueoak", "blueoak", r"blueoak 1 0 0", "bare"),
    ("boost", "bsl", r"bsl 1 0", "tag"),
    ("bsl", "busl", r"busl 1 1", "bare"),
    ("sspl", "sspl", r"sspl ?v? ?1(?: 0)?", "bare"),
    ("elastic", "elastic", r"elastic 2 0", "tag"),
    ("unlicense", "unlicense", r"unlicense", "tag"),
    ("wtfpl", "wtfpl", r"wtfpl", "bare"),
    ("beerware", "beerware", r"beerware", "bare"),
    ("cc0", "cc0", r"cc0(?: 1 0)?", "tag"),
    ("cc-by", "cc", r"cc by(?: [1234] [05])?", "tag"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?", "tag"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?", "tag"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?", "tag"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?", "tag"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?", "tag"),
    ("odbl", "odbl", r"odbl(?: ?v? ?1 0)?", "tag"),
    ("odc-by", "odc", r"odc by(?: 1 0)?", "bare"),
    ("pddl", "pddl", r"pddl(?: 1 0)?", "tag"),
    ("ofl", "ofl", r"ofl(?: 1 [01])?", "tag"),
    ("psf", "psf", r"psf(?: 2 0)?", "tag"),
    ("psf", "python", r"python 2 0(?: 1)?", "tag"),
    ("ms-pl", "ms", r"ms pl", "tag"),
    ("ms-rl", "ms", r"ms rl", "tag"),
    ("ncsa", "ncsa", r"ncsa", "tag"),
    ("hpnd", "hpnd", r"hpnd", "tag"),
    ("postgresql", "postgresql", r"postgresql", "tag"),
    ("openssl", "openssl", r"openssl", "tag"),
    ("php", "php", r"php 3 01?", "tag"),
    ("ruby", "ruby", r"ruby", "spdx"),
    ("vim", "vim", r"vim", "spdx"),
    ("curl", "curl", r"curl", "spdx"),
    ("json", "json", r"json", "spdx"),
    ("w3c", "w3c", r"w3c", "spdx"),
)
#: Label, keyword, signature sentence of the license's body over normalised words.
BODIES = (
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software"),
    ("ncsa", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal with the software"),
    ("mit-x11", "as contained in this notice", r"except as contained in this notice the names? of (?:[^ ]+ ){1,20}?shall not be used in advertising"),
    ("boost", "hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("isc", "hereby granted", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("bsd-0", "hereby granted", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("hpnd", "hereby granted", r"permission to use copy modify(?: and)?(?: or)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)?(?: is hereby granted)? without fee(?: is hereby granted)?"),
    ("postgresql", "written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution and use", r"redistributions? and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name", r"neither the names? of (?:[^ ]+ ){1,30}?(?:may|nor) (?:[^ ]+ ){0,12}?be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("zlib", "held liable", r"this software is provided as is without any express or implied warranty in no event will the authors? be held liable"),
    ("apache-2", "use reproduction", r"terms and conditions for use reproduction and distribution"),
    ("apache-2", "unless required by", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gnu", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2", "free software", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "free software", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "free software", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "free software", r"gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "free software", r"gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", "copyleft license", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-3", "incorporates the terms", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3", "network server", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("epl", "accompanying program", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0", "associated a work", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "neighboring rights", r"waived all copyright and related or neighboring rights"),
    ("cc", "exercising the licensed", r"by exercising the licensed rights defined below you accept and agree to be bound by"),
    ("artistic-1", "intent of this document", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("ofl", "font projects", r"stimulate worldwide development of collaborative font projects"),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("beerware", "retain this notice", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("wtfpl", "just do what", r"you just do what the f\w* you want to"),
)
#: Priority and weight of marks behind an SPDX tag, behind "license", alone, and of bodies.
SPDX, TAGGED, BARE, BODY = (4, 1.0), (3, 0.9), (2, 0.6), (4, 1.0)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    weight: float
    pattern: re.Pattern


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order: names by family, then by form; marks by where they stand; bodies."""
    made = lambda label, keyword, kind, pattern: Rule(label, keyword, *kind, re.compile(rf"(?<![^ ]){pattern}(?![^ ])"))
    named = [made(label, keyword, (priority, weight), form.format(f"(?:{name})")) for label, keyword, name in FAMILIES for _, priority, weight, form in FORMS]
    operand = rf"(?:{'|'.join(pattern for _, _, pattern, _ in MARKS)})(?: with(?: [^ ]+){{1,4}}? exception(?: \d+){{0,2}})?"
    spdx = [made(label, keyword, SPDX, rf"spdx license identifier (?:{operand} (?:or|and) ){{0,6}}({pattern})") for label, keyword, pattern, _ in MARKS]
    tagged = [
        made(label, keyword, TAGGED, rf"licen[cs]ed? (?:(?:is|as|type|name|under|the|an?) ){{0,3}}({pattern})") for label, keyword, pattern,
        at in MARKS if at != "spdx"
    ]
    bare = [made(label, keyword, BARE, pattern) for label, keyword, pattern, at in MARKS if at == "bare"]
    return (*named, *spdx, *tagged, *bare, *(made(label, keyword, BODY, pattern) for label, keyword, pattern in BODIES))


#: Each keyword's longest word, in bytes: what the prefilter looks for in the raw text.
PREFILTER = tuple(dict.fromkeys(max(r.keyword.split(" "), key=len).encode() for r in rules()))


@cache
def gated() -> tuple[tuple[str, tuple[tuple[int, Rule], ...]], ...]:
    """For each keyword, its rules with their numbers."""
    keywords = dict.fromkeys(r.keyword for r in rules())
    return tuple((f" {k}", tuple((n, r) for n, r in enumerate(rules()) if r.keyword == k)) for k in keywords)


_BASE_PATTERN = tuple((re.compile(rf"(?<![^ ]){p}(?![^ ])"), label) for p, label in BASE)
_INSIDE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def surviving(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, priority, rule number), those that no containing interval of higher priority, or of equal
    priority and greater length, suppresses; equal intervals of one priority leave the earliest rule."""
    reach: dict[int, tuple[int, int]] = {}
    out = []
    for start, end, priority, number in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if not any(p >= priority and e >= end for p, (e, _) in reach.items()):
            out.append((start, end, priority, number))
        if end > reach.get(priority, (-1, 0))[0]:
            reach[priority] = (end, start)
    return out


def scan(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Of a lower-cased text: (word, label) of each base place, and (first word, last word, label, weight) of each
    detection that survives."""
    words = WORD.findall(text)
    joined = " ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    base = [(bisect_right(starts, m.start()) - 1, label) for pattern, label in _BASE_PATTERN for m in pattern.finditer(joined)]
    found, every, padded = [], rules(), f" {joined}"
    for keyword, own in gated():
        if keyword in padded:
            found += [(*m.span(m.lastindex or 0), rule.priority, number) for number, rule in own for m in rule.pattern.finditer(joined)]
    kept = surviving(found)
    return base, [(bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1, every[n].label, every[n].weight) for a, b, _, n in kept]


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for each row of docs."""
    detection = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            n = batch.num_rows
            counts = np.diff(spans(data, offsets, _INSIDE[data])[2])
            whole = data.tobytes().lower()
            rows = [(0, None, None, "", "", 0.0, [])] * n
            for i in range(n):
                a, b = offsets[i], offsets[i + 1]
                if any(whole.find(m, a, b) >= 0 for m in PREFILTER):
                    base, found = scan(whole[a:b].decode())
                    names = {label for _, label in base}
                    score = max([w for *_, w in found] + [1.0] * bool(base), default=0.0)
                    rows[i] = (
                        len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted(names)),
                        ",".join(sorted(names | {x[2] for x in found})), score,
                        [dict(zip(("first_word", "last_word", "label", "weight"), x, strict=True)) for x in found]
                    )
            columns = [
                pa.array(list(c), t) for c,
                t in zip(
                    zip(*rows, strict=True),
                    (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(detection)), strict=True
                )
            ]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts), *columns],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first_word:bigint,last_word:bigint,label:string,weight:double>>"
    )
