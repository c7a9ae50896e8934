"""License scans by ordered signature rules, in DataFrame operations alone.

The text becomes its lower-cased words with single blanks between.  A cheap keyword test lets through the few
texts that may name a license; the rules whose keyword such a text holds are then matched as regular
expressions.  Each match is an interval of words with the rule's tier and its place in the list; a detection is
suppressed where one of a stronger tier, or of its own, contains its interval, and of equal intervals of one
tier the first rule's stays.  So "gnu lesser general public license version 2 1 or later" is that alone: neither
2.1 without later versions, nor the GPL, whose name it holds.  A version is never the beginning of a longer one.
Short identifiers count with their suffixes, after "spdx" or, where no program has that name, alone.  A plus sign is no
word, so "GPL-2.0+" is read as "GPL-2.0".  The base phrases always count.

Everything is one narrow projection: no shuffle, and rows need no key.  Defined results: null and empty texts
have no words, no labels and score 0; null or repeated ids stay separate rows; an empty table gives an empty
result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, bound, in_blocks, sums_before

NOT_WORD_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Rule(NamedTuple):
    label: str
    keyword: str  # any match holds it, at a word's start
    pattern: str  # over words with single blanks
    tier: int  # 1 is the strongest
    trust: float


BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
TIERS = 4
VERSION = "(?:version |v ?)?"
LATER = "(?:or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?|only or later)"
SPDX = "spdx(?: licen[cs]e identifier)?"
UNDER = "licen[cs]ed under (?:the )?(?:terms of (?:the )?)?"

GNU = {
    "gpl": (r"(?:gnu )?general public licen[cs]e", "general public", ("1 0", "2 0", "3 0")),
    "lgpl": (r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public", ("2 0", "2 1", "3 0")),
    "agpl": (r"(?:gnu )?affero general public licen[cs]e", "affero", ("1 0", "3 0")),
    "gfdl": (r"(?:gnu )?free documentation licen[cs]e", "free documentation", ("1 1", "1 2", "1 3")),
}
CC_PARTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s?",
            "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike",
            "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
VERSIONED = {
    "apache": (r"apache (?:software )?licen[cs]e", "apache", ("1 0", "1 1", "2 0")),
    "mpl": (r"mozilla public licen[cs]e", "mozilla", ("1 0", "1 1", "2 0")),
    "epl": (r"eclipse public licen[cs]e", "eclipse", ("1 0", "2 0")),
    "cddl": (r"common development and distribution licen[cs]e", "common development", ("1 0", "1 1")),
    "eupl": (r"european union public licen[cs]e", "european union", ("1 0", "1 1", "1 2")),
    "osl": (r"open software licen[cs]e", "open software", ("1 0", "2 0", "2 1", "3 0")),
    "afl": (r"academic free licen[cs]e", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    "artistic": (r"artistic licen[cs]e", "artistic licen", ("1 0", "2 0")),
    "bsl": (r"boost software licen[cs]e", "boost software", ("1 0",)),
    "cpl": (r"common public licen[cs]e", "common public", ("1 0",)),
    "ecl": (r"educational community licen[cs]e", "educational community", ("1 0", "2 0")),
    "lppl": (r"latex project public licen[cs]e", "latex project", ("1 0", "1 1", "1 2", "1 3a", "1 3c")),
    "ms-pl": (r"microsoft public licen[cs]e", "microsoft public", ()),
    "ms-rl": (r"microsoft reciprocal licen[cs]e", "microsoft reciprocal", ()),
    "ncsa": (r"university of illinois ncsa open source licen[cs]e", "ncsa", ()),
    "odbl": (r"(?:open data commons )?open database licen[cs]e", "open database", ("1 0",)),
    "ofl": (r"(?:sil )?open font licen[cs]e", "open font", ("1 0", "1 1")),
    "php": (r"php licen[cs]e", "php licen", ("3 0", "3 01")),
    "psf": (r"python software foundation licen[cs]e", "python software", ("2 0",)),
    "ruby": (r"ruby licen[cs]e", "ruby licen", ()),
    "upl": (r"universal permissive licen[cs]e", "universal permissive", ("1 0",)),
    "vim": (r"vim licen[cs]e", "vim licen", ()),
    "w3c": (r"w3c software (?:notice and )?licen[cs]e", "w3c software", ()),
    "zlib": (r"zlib (?:libpng )?licen[cs]e", "zlib", ()),
    "zpl": (r"zope public licen[cs]e", "zope", ("1 1", "2 0", "2 1")),
    "cecill": (r"cecill(?: free software)? licen[cs]e", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    "isc": (r"isc licen[cs]e", "isc licen", ()),
    "beerware": (r"beerware licen[cs]e", "beerware", ()),
    "wtfpl": (r"do what the fuck you want to public licen[cs]e", "you want to public", ("1 0", "2 0")),
    "unlicense": (r"the unlicense", "unlicense", ()),
    "cc0": (r"(?:creative commons )?cc0", "cc0", ("1 0",)),
    "odc-by": (r"open data commons attribution licen[cs]e", "open data commons", ("1 0",)),
    "pddl": (r"public domain dedication and licen[cs]e", "public domain", ("1 0",)),
    "openrail": (r"openrail(?: m)?(?: licen[cs]e)?", "openrail", ()),
    "llama": (r"llama [0-9](?: [0-9])? community licen[cs]e", "community licen", ()),
}
#: Families with names of programs: with a version, these are licenses after "spdx" alone.
PROGRAMS = ("apache", "php")
#: Short identifiers without versions that are no family's.
PLAIN_IDS = ("mit", "mit-0", "x11", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "json", "openssl")
#: Sentences and names, by hand: (label, keyword, pattern, tier, trust).
NOTICES = [
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1, 0.97),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 2, 0.95),
    ("mit", "the above copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2, 0.9),
    ("mit", "mit licen", r"(?:the )?mit licen[cs]ed?", 2, 0.95),
    ("mit", "licen", r"licen[cs]ed under (?:the )?(?:terms of the )?(?:mit|x11|expat)", 2, 0.9),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?", 1, 0.95),
    ("x11", "x11 licen", r"x11 licen[cs]e", 2, 0.85),
    ("bsl", "permission is hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1, 0.97),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 2, 0.9),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 2, 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 2, 0.9),
    ("bsd-3-clause", "neither the name", r"neither the name of (?:the )?(?:[a-z0-9]+ ){1,8}nor the names of its contributors may be used to endorse or promote products", 1, 0.95),
    ("bsd-4-clause", "all advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, 0.95),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?|simplified bsd licen[cs]e", 1, 0.95),
    ("bsd-2-clause", "freebsd", r"freebsd licen[cs]e", 1, 0.95),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?|(?:new bsd|modified bsd|revised bsd) licen[cs]e", 1, 0.95),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)?|original bsd licen[cs]e", 1, 0.95),
    ("0bsd", "bsd", r"zero clause bsd licen[cs]e", 1, 0.95),
    ("0bsd", "0bsd", r"0bsd", 1, 0.95),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", 2, 0.8),
    ("bsd", "bsd", UNDER + r"bsd(?! [234] clause)", 2, 0.8),
    ("apache", "apache", UNDER + r"apache(?! (?:software |licen|(?:v ?|version )?[0-9]))", 2, 0.8),
    ("apache-2.0", "apache", UNDER + r"apache (?:v ?|version )?2(?: 0)?(?! [0-9](?: |$))", 2, 0.9),
    ("apache-2.0", "apache 2 0", r"apache 2 0(?! (?:[0-9]|http|web|server))", 2, 0.75),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1, 0.95),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 2, 0.9),
    ("isc", "the author disclaims", r"the author disclaims all warranties with regard to this software", 3, 0.7),
    ("zlib", "in no event", r"in no event will the authors be held liable for any damages arising from the use of this software", 2, 0.9),
    ("zlib", "this notice may", r"this notice may not be removed or altered from any source distribution", 2, 0.9),
    ("apache-2.0", "licen", r"licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e", 1, 0.99),
    ("apache-2.0", "apache org", r"apache org licenses license 2 0", 1, 0.97),
    ("apache-1.1", "this product includes", r"this product includes software developed by the apache software foundation", 1, 0.9),
    ("openssl", "this product includes", r"this product includes software developed by the openssl project", 1, 0.95),
    ("gpl", "this program is free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 2, 0.95),
    ("gpl-3.0-or-later", "this program is free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version", 1, 0.99),
    ("gpl-2.0-or-later", "this program is free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version", 1, 0.99),
    ("lgpl", "this library is free", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 2, 0.95),
    ("gpl", "you should have received", r"you should have received a copy of the gnu general public licen[cs]e", 2, 0.9),
    ("lgpl", "you should have received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", 2, 0.9),
    ("agpl", "you should have received", r"you should have received a copy of the gnu affero general public licen[cs]e", 2, 0.9),
    ("gpl-classpath", "classpath exception", r"(?:gpl )?(?:with )?(?:the )?classpath exception", 1, 0.85),
    ("gfdl", "permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 1, 0.97),
    ("mpl-2.0", "this source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 1, 0.99),
    ("mpl-1.1", "the contents of this", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 1, 0.99),
    ("epl", "this program and the", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 2, 0.95),
    ("cddl", "the contents of this", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 2, 0.95),
    ("ofl", "this font software", r"this font software is licen[cs]ed under the sil open font licen[cs]e", 1, 0.97),
    ("lppl", "this work may be", r"this work may be distributed and or modified under the conditions of the latex project public licen[cs]e", 1, 0.97),
    ("json", "the software shall", r"the software shall be used for good not evil", 1, 0.97),
    ("beerware", "you can buy me", r"you can buy me a beer in return", 1, 0.95),
    ("wtfpl", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed", 2, 0.85),
    ("fsf-document", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", 2, 0.8),
    ("cc0", "to the extent possible", r"to the extent possible under law (?:[a-z0-9]+ ){0,8}(?:has )?waived all copyright", 1, 0.95),
    ("cc0", "no rights reserved", r"no rights reserved", 2, 0.8),
    ("cc-by", "creative commons", r"creative commons (?:licen[cs]e )?attribution", 3, 0.8),
    ("cc", "creative commons", r"creative commons(?: public)? licen[cs]e", 3, 0.6),
    ("cc-by-4.0", "attribution 4 0", r"attribution 4 0 international", 1, 0.95),
    ("cc-by-sa-4.0", "attribution share", r"attribution share ?alike 4 0 international", 1, 0.95),
    ("cc-by-nc-4.0", "attribution non", r"attribution non ?commercial 4 0 international", 1, 0.95),
    ("cc-by-nc-sa-4.0", "attribution non", r"attribution non ?commercial share ?alike 4 0 international", 1, 0.95),
    ("odbl", "this database is made", r"this database is made available under the open database licen[cs]e", 1, 0.97),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1, 0.95),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software", 1, 0.9),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|in ?to|to) the public domain", 2, 0.85),
    ("public-domain", "this work is in", r"this work is in the public domain", 2, 0.9),
    ("proprietary", "proprietary and", r"proprietary and confidential", 2, 0.8),
    ("proprietary", "no part of this", r"no part of this (?:publication|book|work|document) may be reproduced", 2, 0.85),
    ("proprietary", "reproduction", r"reproduction (?:in whole or in part )?without (?:written )?permission is prohibited", 2, 0.8),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|work|document|software)", 2, 0.8),
    ("non-commercial", "non commercial use", r"(?:for )?non commercial use only", 2, 0.75),
    ("academic-only", "academic", r"(?:for )?academic (?:and research )?use only", 2, 0.75),
    ("research-only", "research", r"(?:for )?research (?:purposes|use) only", 2, 0.75),
    ("permission", "used with permission", r"used with permission", 3, 0.5),
    ("permission", "reprinted with", r"reprinted with permission", 3, 0.5),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 3, 0.6),
    ("all-rights-reserved", "alle rechte", r"alle rechte vorbehalten", 3, 0.6),
    ("all-rights-reserved", "tous droits", r"tous droits réservés", 3, 0.6),
    ("all-rights-reserved", "todos los derechos", r"todos los derechos reservados", 3, 0.6),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}", 3, 0.5),
    ("unknown", "licen", r"licen[cs]ed under", 4, 0.3),
    ("unknown", "licen", r"(?:under|see) (?:the )?(?:terms of the )?licen[cs]e", 4, 0.3),
    ("unknown", "see the file", r"see the file (?:license|licence|copying)", 4, 0.3),
    ("unknown", "terms of use", r"terms of use", 4, 0.2),
    ("unknown", "spdx", r"spdx licen[cs]e identifier [a-z0-9]+", 4, 0.4),
]


#: No version is the beginning of a longer one.
ENDS = r"(?! [0-9](?: |$))"


def _rules() -> Iterator[Rule]:
    for family, (name, keyword, versions) in (GNU | VERSIONED).items():
        ident = family.replace("-", " ")
        yield Rule(family, keyword, name, 2, 0.8)
        yield Rule(family, "spdx", f"{SPDX} {ident}", 1, 0.9)
        if family in GNU:
            unversioned = "(?! (?:v ?|version )?[0-9])"
            yield Rule(family, family, f"(?:gnu {family}|{UNDER}(?:gnu )?{family}){unversioned}", 2, 0.8)
            yield Rule(family, family, f"{family} licen[cs]ed?{unversioned}", 2, 0.75)
        for version in versions:
            label = f"{family}-{version.replace(' ', '.')}"
            short = version.removesuffix(" 0")
            number = f"{short}(?: 0)?{ENDS}" if short != version else version + ENDS
            published = "(?: as published by the free software foundation(?: either)?)?"
            yield Rule(f"{label}-or-later", keyword, f"{name}{published} {VERSION}{number}(?: of the licen[cs]e)? {LATER}", 1, 0.97)
            yield Rule(label, keyword, f"{name}{published} {VERSION}{number}", 1, 0.95)
            yield Rule(f"{label}-or-later", "spdx", f"{SPDX} {ident} {VERSION}{number} {LATER}", 1, 0.99)
            yield Rule(label, "spdx", f"{SPDX} {ident} {VERSION}{number}(?: only)?", 1, 0.99)
            if family in GNU:
                yield Rule(f"{label}-or-later", family, f"(?:gnu )?{family} ?(?:v ?|version )?{number} {LATER}", 2, 0.9)
                yield Rule(label, family, f"(?:gnu )?{family} ?(?:v ?|version )?{number}", 2, 0.85)
            elif family not in PROGRAMS:
                yield Rule(label, f"{ident} {version}", f"{ident} {version}{ENDS}", 2, 0.8)
    for parts, words in CC_PARTS.items():
        kind = "cc-" + parts.replace(" ", "-")
        yield Rule(kind, "cc by", f"cc {parts}", 2 if len(parts) > 2 else 3, 0.8)
        yield Rule(kind, "creative commons", f"creative commons {words}", 2, 0.85)
        for version in CC_VERSIONS:
            label = f"{kind}-{version.replace(' ', '.')}"
            yield Rule(label, "cc by", f"cc {parts} {version}{ENDS}", 1, 0.97)
            yield Rule(label, "creative commons", f"creative commons {words} {version}{ENDS}", 1, 0.95)
            yield Rule(label, "creativecommons", f"creativecommons org licenses {parts} {version}{ENDS}", 1, 0.97)
    for label in PLAIN_IDS:
        yield Rule(label, "spdx", f"{SPDX} {label.replace('-', ' ')}", 1, 0.99)
    for label, keyword, pattern, tier, trust in NOTICES:
        yield Rule(label, keyword, pattern, tier, trust)


RULES = list(_rules())
KEYWORDS = sorted({r.keyword for r in RULES} | {phrase.split(" ")[0] + " " + phrase.split(" ")[1] for phrase, _ in BASE})


def squeezed(text: Column) -> Column:
    """The words of a text between single blanks, as " w0 w1 ... ", in their own case; one blank for no words.

    A-Z and a-z bound words alike, so words can be counted before lower-casing.
    """
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), NOT_WORD_RAW, " ")


def _gate() -> str:
    """A pattern for any keyword at a word's start, branching by the first letter."""
    by_letter: dict[str, list[str]] = {}
    for k in KEYWORDS:
        by_letter.setdefault(k[0], []).append(k[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + ")"


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def spans(norm: Column, pattern: Column) -> Column:
    """Array of (first word, last word) for all matches of a pattern that stand at word bounds."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    between, found = F.split(norm, whole, -1), F.regexp_extract_all(norm, whole, F.lit(0))
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(_blanks(b).alias("b"), _blanks(m).alias("m")))
    return bound(sizes, lambda z: F.zip_with(z, sums_before(F.transform(z, lambda x: x["b"] + x["m"])), lambda x, at: F.struct((at + x["b"] - 1).alias("first"), (at + x["b"] + x["m"] - 1).alias("last"))))


def _suppressed(found: Column) -> Column:
    """Of detections, drop those whose interval one of a stronger tier, of their own, or an equal one of an earlier rule contains.

    One sweep in order of the first word, longer ones first: what contains a detection comes before it.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("back"), d["tier"].alias("tier"), d["rule"].alias("rule"), d["label"].alias("label"), d["trust"].alias("trust"))))
    kept = "array<struct<first:int,back:int,tier:int,rule:int,label:string,trust:double>>"

    def step(a: Column, d: Column) -> Column:
        reach = F.array_max(F.slice(a["reach"], 1, d["tier"] + 1))
        # reach[i]: the last word of any detection of tier i (from 1) so far; its first element stands for no tier
        hidden = reach >= -d["back"]
        return F.struct(
            F.transform(a["reach"], lambda r, i: F.when(i == d["tier"], F.greatest(r, -d["back"])).otherwise(r)).alias("reach"),
            F.when(hidden, a["out"]).otherwise(F.concat(a["out"], F.array(d))).alias("out"),
        )

    tiers = F.sequence(F.lit(0), F.lit(TIERS))
    furthest = lambda block: F.transform(tiers, lambda t: F.array_max(F.transform(F.filter(block, lambda d: d["tier"] == t), lambda d: -d["back"])))

    def sweep(block: Column, before: Column) -> Column:
        reach = F.transform(tiers, lambda t: F.coalesce(F.array_max(F.transform(before, lambda r: r[t])), F.lit(-1)))
        return F.aggregate(block, F.struct(reach.alias("reach"), F.array().cast(kept).alias("out")), step, lambda a: a["out"])

    # block by block, so that a text of very many detections takes no square of their number
    return bound(in_blocks(ordered), lambda blocks: bound(F.transform(blocks, furthest), lambda ends: F.flatten(F.transform(blocks, lambda block, b: sweep(block, F.slice(ends, 1, b))))))


def _labelled(found: Column, label: Column) -> Column:
    return F.transform(found, lambda s: F.struct(label.alias("label"), s["first"].alias("first"), s["last"].alias("last")))


def scan(docs: DataFrame, *, payload: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``payload`` columns with n_words, base (phrases found: label, first, last) and detections (label, tier, trust, first, last)."""
    rules = F.from_json(F.lit(json.dumps([r._asdict() | {"rule": k} for k, r in enumerate(RULES)])), "array<struct<label:string,keyword:string,pattern:string,tier:int,trust:double,rule:int>>")
    keywords = F.array(*[F.lit(" " + k) for k in KEYWORDS])
    norm = F.col("norm")
    # the gate may use full lower-casing: it never misses an A-Z that the exact form would lower
    words = docs.select(*payload, squeezed(F.col(text_col)).alias("words"))
    gated = words.select(
        *payload, F.greatest(_blanks(F.col("words")) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.when(F.lower("words").rlike(_gate()), ascii_lower(F.col("words"))).alias("norm"),
    ).withColumn("held", F.filter(keywords, lambda k: F.contains(norm, k)))
    empty = "array<struct<label:string,tier:int,trust:double,first:int,last:int>>"
    base = F.flatten(F.array(*[_labelled(spans(norm, F.lit(phrase)), F.lit(label)) for phrase, label in BASE]))
    found = F.flatten(F.transform(
        F.filter(rules, lambda r: F.array_contains(F.col("held"), F.concat(F.lit(" "), r["keyword"]))),
        lambda r: F.transform(spans(norm, r["pattern"]), lambda s: F.struct(r["label"].alias("label"), r["tier"].alias("tier"), r["trust"].alias("trust"), r["rule"].alias("rule"), s["first"].alias("first"), s["last"].alias("last"))),
    ))
    some = F.size("held") > 0
    read = gated.select(
        *payload,
        "n_words",
        F.when(some, base).otherwise(F.array().cast("array<struct<label:string,first:int,last:int>>")).alias("base"),
        F.when(some, found).otherwise(F.array().cast(empty.replace("first", "rule:int,first"))).alias("found"),
    )
    # an unnamed license is one only where nothing stronger names it
    named = F.filter("found", lambda d: d["tier"] < TIERS)
    kept = F.when(F.size("found") > 0, _suppressed(F.when(F.size(named) > 0, named).otherwise(F.col("found"))))
    return read.select(
        *payload, "n_words", "base",
        F.coalesce(F.transform(kept, lambda d: F.struct(d["label"].alias("label"), d["tier"].alias("tier"), d["trust"].alias("trust"), d["first"].alias("first"), (-d["back"]).alias("last"))), F.array().cast(empty)).alias("detections"),
    )


def op2_license_scan(docs: DataFrame) -> DataFrame:
    """Digest of the scan: counts and places of the base phrases, labels of both kinds, and the strongest trust."""
    read = scan(docs)
    names = lambda column: F.transform(column, lambda d: d["label"])
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    trusts = F.concat(F.transform("detections", lambda d: d["trust"]), F.transform("base", lambda d: F.lit(0.8)))
    return read.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first"])).cast("long").alias("last_word"),
        join(names(F.col("base"))).alias("base_labels"),
        join(F.concat(names(F.col("base")), names(F.col("detections")))).alias("labels"),
        F.coalesce(F.array_max(trusts), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
