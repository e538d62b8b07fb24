"""License scans by ordered signature rules, in DataFrame functions only.

Each rule has keywords, one of which every match contains, a regular expression over the normalised words, a priority and a label. A text
is first reduced to its words with single blanks; rules run only where one of their keywords occurs; each
detection is an interval of words. A detection goes if a stronger one (smaller priority, or the same
priority and at least as long) contains its interval. All of it happens inside the row: no shuffle.

Null or empty text: no words, no labels, score 0. Texts are taken whole, of any length. Rows that repeat, and
texts that tie, each have their own equal results. Empty table: no rows. Extra columns stay; those with the name of
a result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside

# The phrases every scan reports, with their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Family: (keywords that gate it, between bars, words that name it, versions, label stem).
FAMILIES = (
    ("apache", r"apache(?: software)?", ("1 0", "1 1", "2 0"), "apache"),
    ("general public", r"(?:gnu )?general public", ("1", "2", "2 0", "3", "3 0"), "gpl"),
    ("lesser", r"(?:gnu )?lesser general public", ("2 1", "3", "3 0"), "lgpl"),
    ("library", r"(?:gnu )?library general public", ("2", "2 0"), "lgpl"),
    ("affero", r"(?:gnu )?affero general public", ("1", "3", "3 0"), "agpl"),
    ("documentation", r"(?:gnu )?free documentation", ("1 1", "1 2", "1 3"), "gfdl"),
    ("mozilla", r"mozilla public", ("1 0", "1 1", "2 0"), "mpl"),
    ("eclipse", r"eclipse public", ("1 0", "2 0"), "epl"),
    ("european", r"european union public", ("1 0", "1 1", "1 2"), "eupl"),
    ("boost", r"boost software", ("1 0",), "bsl"),
    ("artistic", r"artistic", ("1 0", "2 0"), "artistic"),
    ("academic", r"academic free", ("2 1", "3 0"), "afl"),
    ("python software", r"python software foundation", ("2", "2 0"), "psf"),
    ("microsoft", r"microsoft (?:public|reciprocal)", ("1 0",), "mspl"),
    ("zope", r"zope public", ("2 0", "2 1"), "zpl"),
    ("latex", r"latex project public", ("1 0", "1 3"), "lppl"),
    ("open font", r"(?:sil )?open font", ("1 0", "1 1"), "ofl"),
    ("database", r"open database", ("1 0",), "odbl"),
    ("mit", r"mit", (), "mit"),
    ("bsd", r"(?:[234] clause |new |simplified |modified )?bsd", (), "bsd"),
    ("isc", r"isc", (), "isc"),
    ("zlib", r"zlib(?: libpng)?", (), "zlib"),
    ("unlicense", r"unlicense", (), "unlicense"),
    ("want to public|wtf public", r"(?:do what the fuck you want to|wtf) public", (), "wtfpl"),
)
#: What makes a named license a grant: text before the name, text after it, priority (smaller wins).
GRANTS = (
    (r"(?:is |are |be )?(?:dual )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?", r"(?: licen[sc]e)?", 1),
    (r"(?:is |are )?(?:released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?", r"(?: licen[sc]e)?", 1),
    (r"subject to the terms of the ", r"(?: licen[sc]e)", 1),
    (r"(?:see|read) the ", r" licen[sc]e", 2),
    (r"", r" licen[sc]e", 3),
)
#: Creative Commons: the clauses as they are abbreviated, and as they are written out.
CC_CLAUSES = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative|atives|s)?(?: works)?",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative|atives|s)?(?: works)?",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Short identifiers as they stand in file headers and metadata, and their labels.
SPDX = {
    "apache 1 1": "apache-1.1", "apache 2 0": "apache-2.0", "gpl 1 0": "gpl-1.0", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0", "lgpl 2 0": "lgpl-2.0", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3.0",
    "agpl 3 0": "agpl-3.0", "gfdl 1 2": "gfdl-1.2", "gfdl 1 3": "gfdl-1.3", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2",
    "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "bsd 4 clause": "bsd", "0bsd": "0bsd", "bsl 1 0": "bsl-1.0", "cddl 1 0": "cddl-1.0", "cddl 1 1": "cddl-1.1", "cc0 1 0": "cc0", "ms pl": "mspl", "ms rl": "mspl",
    "artistic 1 0": "artistic-1.0", "artistic 2 0": "artistic-2.0", "afl 3 0": "afl-3.0", "osl 3 0": "osl-3.0", "ofl 1 1": "ofl-1.1", "odbl 1 0": "odbl-1.0", "pddl 1 0": "pddl-1.0", "zpl 2 1": "zpl-2.1", "ncsa": "ncsa", "upl 1 0": "upl-1.0", "wtfpl": "wtfpl",
}
#: Identifiers that are words of their own; they count only behind "spdx license identifier".
SPDX_WORDS = {"mit": "mit", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "postgresql": "postgresql", "python 2 0": "psf-2.0", "psf 2 0": "psf-2.0", "x11": "x11", "curl": "curl", "ruby": "ruby", "vim": "vim"}
#: Short names in running text, which count with a word that says so: (keyword, expression, label).
SHORT_NAMES = (
    ("gplv1", r"gplv1", "gpl-1"), ("gplv2", r"gplv2", "gpl-2"), ("gplv3", r"gplv3", "gpl-3"), ("lgplv2", r"lgplv2(?: 1)?", "lgpl-2"), ("lgplv3", r"lgplv3", "lgpl-3"), ("agplv3", r"agplv3", "agpl-3"),
    ("gpl", r"gpl v ?2", "gpl-2"), ("gpl", r"gpl v ?3", "gpl-3"), ("gpl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?gpl", "gpl"), ("gpl", r"gpl licen[sc]e", "gpl"), ("gpl", r"gnu gpl", "gpl"),
    ("lgpl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?lgpl", "lgpl"), ("lgpl", r"(?:gnu lgpl|lgpl licen[sc]e)", "lgpl"), ("agpl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?agpl", "agpl"), ("agpl", r"(?:gnu agpl|agpl licen[sc]e)", "agpl"),
    ("mpl", r"mpl (?:1 1|2 0) licen[sc]e", "mpl"), ("mpl", r"(?:licen[sc]ed|released) under (?:the )?mpl", "mpl"), ("epl", r"(?:licen[sc]ed|released) under (?:the )?epl", "epl"), ("cddl", r"(?:licen[sc]ed|released) under (?:the )?cddl", "cddl"),
    ("x11", r"x11 licen[sc]e", "x11"), ("ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", "ncsa"), ("postgresql", r"postgresql licen[sc]e", "postgresql"), ("openssl", r"openssl licen[sc]e", "openssl"), ("php", r"php licen[sc]e(?: version 3 0?1)?", "php"),
    ("ruby", r"ruby licen[sc]e", "ruby"), ("perl", r"same terms as perl itself", "perl"), ("beerware", r"beerware licen[sc]e", "beerware"), ("in return", r"buy me a beer in return", "beerware"), ("good not evil", r"the software shall be used for good not evil", "json"), ("vim", r"vim licen[sc]e", "vim"), ("curl", r"curl licen[sc]e", "curl"),
    ("wtfpl", r"(?:licen[sc]ed|released) under (?:the )?wtfpl", "wtfpl"), ("fuck", r"do what the fuck you want to public licen[sc]e", "wtfpl"), ("unlicense", r"unlicense org", "unlicense"),
    ("common development", r"common development and distribution licen[sc]e(?: cddl)?(?: version)?(?: 1 [01])?", "cddl"), ("common public", r"common public licen[sc]e(?: version)?(?: 1 0)?", "cpl"), ("universal permissive", r"universal permissive licen[sc]e(?: v ?1 0)?", "upl"), ("open software", r"open software licen[sc]e(?: version)?(?: [123] 0)?", "osl"),
    ("mulan", r"mulan (?:permissive|public) (?:software )?licen[sc]e(?: v ?[12])?", "mulan"), ("elastic", r"elastic licen[sc]e(?: 2 0)?", "elastic"), ("server side", r"server side public licen[sc]e(?: v ?1)?", "sspl"), ("business source", r"business source licen[sc]e(?: 1 [01])?", "busl"), ("polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter) licen[sc]e(?: 1 0 0)?", "polyform"),
    ("commons clause", r"commons clause (?:licen[sc]e )?condition", "commons-clause"), ("openrail", r"(?:creativeml )?openrail(?: m)?", "rail"), ("responsible ai", r"responsible ai licen[sc]e", "rail"), ("llama", r"llama [23] community licen[sc]e(?: agreement)?", "llama"), ("open government", r"open government licen[sc]e(?: v ?[123](?: 0)?)?", "ogl"), ("open data commons", r"open data commons (?:attribution|public domain dedication and|open database) licen[sc]e", "odc"),
    ("community data", r"community data licen[sc]e agreement (?:permissive|sharing)", "cdla"), ("free art", r"free art licen[sc]e(?: 1 3)?", "fal"), ("intel", r"intel simplified software licen[sc]e", "issl"), ("nvidia", r"nvidia (?:source code|software) licen[sc]e", "nvidia"), ("oracle", r"oracle (?:technology network|binary code) licen[sc]e", "oracle"), ("apple public source", r"apple public source licen[sc]e(?: 2 0)?", "apsl"), ("ibm public", r"ibm public licen[sc]e(?: version)?(?: 1 0)?", "ipl"),
    ("sun", r"sun (?:industry standards source|public) licen[sc]e", "sun"), ("q public|qt public", r"(?:q|qt) public licen[sc]e", "qpl"), ("sleepycat", r"sleepycat licen[sc]e", "sleepycat"), ("tcl", r"tcl tk licen[sc]e", "tcl"), ("w3c", r"w3c software (?:notice and|and document) licen[sc]e", "w3c"), ("unicode", r"unicode licen[sc]e (?:agreement|v3)", "unicode"), ("bouncy castle", r"bouncy castle licen[sc]e", "bouncycastle"), ("boost org", r"boost org license 1 0 txt", "bsl-1.0"),
)
#: Addresses of license texts, as words.
ADDRESSES = (
    ("apache org", r"apache org licenses license 2 0", "apache-2.0"), ("apache org", r"apache org licenses license 1 1", "apache-1.1"), ("opensource org", r"opensource org licenses? mit", "mit"), ("opensource org", r"opensource org licenses? bsd [23] clause", "bsd"), ("opensource org", r"opensource org licenses? isc", "isc"),
    ("opensource org", r"opensource org licenses? apache 2 0", "apache-2.0"), ("opensource org", r"opensource org licenses? gpl [23] 0", "gpl"), ("opensource org", r"opensource org licenses? mpl 2 0", "mpl-2.0"), ("gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0", "gpl-2.0"), ("gnu org", r"gnu org licenses gpl(?: 3 0)?", "gpl-3.0"),
    ("gnu org", r"gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?", "lgpl"), ("gnu org", r"gnu org licenses agpl(?: 3 0)?", "agpl-3.0"), ("gnu org", r"gnu org licenses fdl(?: 1 3)?", "gfdl"), ("gnu org", r"gnu org copyleft", "copyleft"), ("mozilla org", r"mozilla org mpl 2 0", "mpl-2.0"), ("mozilla org", r"mozilla org mpl 1 1", "mpl-1.1"), ("mozilla org", r"mozilla org mpl", "mpl"),
    ("eclipse org", r"eclipse org legal epl v10", "epl-1.0"), ("eclipse org", r"eclipse org legal epl (?:2 0|v20)", "epl-2.0"), ("creativecommons org", r"creativecommons org publicdomain zero 1 0", "cc0"), ("creativecommons org", r"creativecommons org publicdomain mark 1 0", "public-domain"), ("unlicense org", r"https? unlicense org", "unlicense"), ("wtfpl net", r"wtfpl net", "wtfpl"),
    ("scripts sil org", r"scripts sil org ofl", "ofl"), ("opendatacommons org", r"opendatacommons org licenses odbl(?: 1 0)?", "odbl"), ("opendatacommons org", r"opendatacommons org licenses by(?: 1 0)?", "odc-by"), ("opendatacommons org", r"opendatacommons org licenses pddl(?: 1 0)?", "pddl"), ("joinup ec europa eu", r"joinup ec europa eu collection eupl", "eupl"),
)
#: Single sentences of well-known texts: (keywords, expression, priority, label).
SENTENCES = (
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1, "mit"),
    ("redistribution and use", r"redistribution and use in source and binary forms", 1, "bsd"),
    ("permission to use copy", r"permission to use copy modify and or distribute this software", 1, "isc"),
    ("provided as is", r"(?:software|work|material) is provided as is(?: without (?:any )?warranty)?", 4, "as-is"),
    ("without warranty", r"without warranty of any kind", 4, "as-is"),
    ("public domain", r"(?:released |dedicated |placed )?(?:in|into|to) the public domain", 2, "public-domain"),
    ("cc0|creative commons zero", r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", 1, "cc0"),
    ("apache", r"licen[sc]ed under the apache licen[sc]e version 2 0 the license you may not use this file except in compliance with the license", 0, "apache-2.0"),
    ("you may obtain a copy", r"you may obtain a copy of the license at", 2, "license-notice"),
    ("compliance with the", r"you may not use this (?:file|work|software) except in compliance with the licen[sc]e", 2, "license-notice"),
    ("redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation(?: either)? version 2(?: of the license)?(?: or at your option any later version)?", 0, "gpl-2"),
    ("redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or at your option any later version)?", 0, "gpl-3"),
    ("redistribute it", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", 0, "lgpl"),
    ("redistribute it", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 0, "agpl"),
    ("fitness for a particular", r"without even the implied warranty of merchantability or fitness for a particular purpose", 3, "as-is"),
    ("fitness for a particular", r"merchantability(?: and)? fitness for a particular purpose", 4, "as-is"),
    ("received a copy", r"you should have received a copy of the gnu (?:(?:lesser|affero|library) )?general public licen[sc]e", 2, "gpl-notice"),
    ("free software foundation", r"free software foundation inc", 4, "gpl-notice"),
    ("source code must retain", r"redistributions of source code must retain the above copyright notice", 1, "bsd"),
    ("binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice", 1, "bsd"),
    ("endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission", 1, "bsd-3-clause"),
    ("advertising materials", r"all advertising materials mentioning features or use of this software", 1, "bsd-4-clause"),
    ("above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies", 1, "mit"),
    ("deal in the software", r"to deal in the software without restriction", 2, "mit"),
    ("origin of this software", r"the origin of this software must not be misrepresented", 1, "zlib"),
    ("altered source versions", r"altered source versions must be plainly marked as such", 1, "zlib"),
    ("free and unencumbered", r"this is free and unencumbered software released into the public domain", 0, "unlicense"),
    ("source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0", 0, "mpl-2.0"),
    ("accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e(?: v ?[12] ?0)?", 0, "epl"),
    ("boost software", r"distributed under the boost software licen[sc]e version 1 0", 0, "bsl-1.0"),
    ("font", r"this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1", 0, "ofl-1.1"),
    ("waived all copyright", r"waived all copyright and related or neighboring rights", 1, "cc0"),
    ("no rights reserved", r"no rights reserved", 2, "cc0"),
    ("some restrictions", r"some restrictions apply", 4, "restricted"),
    ("personal use only", r"(?:for )?personal use only", 3, "non-commercial"),
    ("for research|for educational", r"for (?:research|educational)(?: (?:and|or) (?:research|educational))? (?:use|purposes) only", 3, "research-only"),
    ("evaluation", r"for evaluation purposes only", 3, "evaluation"),
    ("internal use only", r"for internal use only", 2, "proprietary"),
    ("strictly prohibited", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: of this (?:file|work|software|material))?(?: via any medium)? is strictly prohibited", 1, "proprietary"),
    ("do not distribute", r"do not distribute", 3, "proprietary"),
    ("may not be reproduced", r"may not be reproduced (?:or transmitted )?(?:in whole or in part )?without (?:the )?(?:prior )?(?:written )?permission", 1, "reserved"),
    ("reprinted", r"reprinted (?:with|by) permission", 3, "reserved"),
    ("prior written permission", r"without (?:the )?prior written permission of the (?:publisher|author|owner)", 2, "reserved"),
    ("licensed material", r"licensed material", 4, "license-notice"),
    ("end user", r"end user licen[sc]e agreement", 2, "eula"),
    ("terms of service", r"subject to (?:the |our )?terms of service", 3, "terms"),
    ("no part of this", r"no part of this (?:publication|work|book|document) may be reproduced", 1, "reserved"),
    ("rights reserved|rights are reserved", r"(?:all|some) rights (?:are )?reserved", 2, "reserved"),
    ("proprietary", r"proprietary and confidential(?: information)?", 1, "proprietary"),
    ("confidential", r"strictly confidential", 3, "proprietary"),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 4, "copyright"),
    ("non commercial", r"(?:for )?non commercial (?:use|purposes)(?: only)?", 3, "non-commercial"),
    ("contains trade", r"contains trade secrets?", 2, "proprietary"),
)
#: Confidence of a detection by its priority.
CONFIDENCE = (1.0, 0.9, 0.75, 0.6, 0.3)


def rules() -> list[tuple[str, str, int, str]]:
    """All rules as (keywords, expression, priority, label), ordered: named versions before bare names."""
    out = [(k, rf"spdx licen[sc]e identifier {k}(?: only| or later)?", 0, v) for k, v in (SPDX | SPDX_WORDS).items()]
    out += [(k, rf"{k}(?: only| or later)?", 2, v) for k, v in SPDX.items()]
    out += [(k, x, 1, v) for k, x, v in SHORT_NAMES] + [(k, x, 1, v) for k, x, v in ADDRESSES]
    for before, after, priority in GRANTS:
        for keyword, name, versions, label in FAMILIES:
            out += [(keyword, rf"{before}{name}{after}(?: as published by the free software foundation)?(?: either)?(?:(?: version| v) ?| ){v}", max(1, priority - 1), f"{label}-{v.replace(' ', '.')}") for v in versions]
            out.append((keyword, f"{before}{name}{after}", priority, label))
    for clause, words in CC_CLAUSES.items():
        stem = f"cc-{clause.replace(' ', '-')}"
        for v in CC_VERSIONS:
            name = f"{stem}-{v.replace(' ', '.')}"
            out += [(f"cc {clause}", rf"cc {clause} {v}", 1, name), ("creativecommons org", rf"creativecommons org licenses {clause} {v}", 0, name), ("creative commons", rf"creative commons {words}(?: (?:international|unported|generic))?(?: (?:public )?licen[sc]e)?(?: version)? {v}", 1, name)]
        out += [(f"cc {clause}", rf"cc {clause}", 2, stem), ("creative commons", rf"creative commons {words}(?: (?:public )?licen[sc]e)?", 1, stem)]
    return out + list(SENTENCES)


def gate_word(keyword: str) -> str:
    """The longest word of a keyword: a text without it has no match of the keyword's rules."""
    return max(keyword.split(), key=len)


def gate_words() -> list[str]:
    """Words of which every match of any rule contains one."""
    return sorted({gate_word(k) for keywords, *_ in rules() for k in keywords.split("|")})


def normalised(text: Column) -> Column:
    """The words of a text, each with a blank before it, and one blank at the end."""
    # lower() also maps letters beyond ASCII, to letters that are word characters too: words stay the same words
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _detections(norm: Column, rule: Column) -> Column:
    """Word intervals [start, end) of a rule's matches, from the pieces between them."""
    pattern = F.concat(F.lit(" (?:"), rule["pattern"], F.lit(")(?= )"))
    found = F.regexp_extract_all(norm, pattern, F.lit(0))
    pieces = F.split(norm, pattern, -1)
    # a match begins with the blank before its first word: the blanks before it are the words before it
    walk = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,last:int,priority:int,label:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + _blanks(x["p"]) + _blanks(x["m"])).cast("int").alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + _blanks(x["p"])).cast("int").alias("start"),
                        (acc["at"] + _blanks(x["p"]) + _blanks(x["m"])).cast("int").alias("last"),
                        rule["priority"].alias("priority"),
                        rule["label"].alias("label"),
                    )
                ),
            ).alias("out"),
        ),
    )
    return F.when(F.size(found) > 0, walk["out"])


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds RESULTS to each row."""
    table = rules()
    literal = F.array(*[F.struct(F.array(*[F.lit(gate_word(x)) for x in k.split("|")]).alias("gates"), F.array(*[F.lit(f" {x} ") for x in k.split("|")]).alias("keywords"), F.lit(p).alias("pattern"), F.lit(n).alias("priority"), F.lit(v).alias("label")) for k, p, n, v in table])
    rows, columns = aside(documents, text, RESULTS, keep_text=True)
    out = rows.withColumn("_norm", normalised(F.col("_text"))).withColumn("_there", F.array_intersect(F.array(*[F.lit(g) for g in gate_words()]), F.split("_norm", " ")))
    norm = F.col("_norm")
    places, firsts, lasts, marks = [], [], [], []
    for phrase, label in BASE_PHRASES:
        there = norm.contains(f" {phrase} ")
        padded = F.lit(f" {phrase} ")
        places.append(F.when(there, F.regexp_count(norm, F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, _blanks(F.substring(norm, F.lit(1), F.instr(norm, padded) - 1))))
        tail = F.instr(F.reverse(norm), F.reverse(padded)) - 1 + len(phrase) + 1  # characters after the phrase's first blank
        lasts.append(F.when(there, _blanks(F.substring(norm, F.lit(1), F.length(norm) - tail - 1))))
        marks.append(F.when(there, F.lit(label)))
    some = F.array_compact(F.array(*marks))
    # few words of a text are gates; only rules of those are asked for their keywords
    there = F.col("_there")
    gate = F.size(there) > 0
    kept = F.flatten(F.array_compact(F.transform(F.filter(literal, lambda r: F.when(F.exists(r["gates"], lambda g: F.array_contains(there, g)), F.exists(r["keywords"], lambda k: F.contains(norm, k))).otherwise(False)), lambda r: _detections(norm, r))))
    # outer intervals first, stronger rules first among equal intervals
    ordered = F.transform(
        F.array_sort(F.transform(kept, lambda d: F.struct(d["start"].alias("a"), (-d["last"]).alias("b"), d["priority"].alias("p"), d["label"].alias("l")))),
        lambda d: F.struct(d["a"].alias("start"), (-d["b"]).alias("last"), d["p"].alias("priority"), d["l"].alias("label")),
    )
    levels = [f"m{p}" for p in range(len(CONFIDENCE))]

    def step(acc, d):
        """Keeps, for each priority, the furthest end so far: a later interval is contained if it ends no further."""
        inside = reduce(lambda a, b: a | b, [(d["priority"] >= p) & (acc[m] >= d["last"]) for p, m in enumerate(levels)])
        ends = [F.when(d["priority"] == p, F.greatest(acc[m], d["last"])).otherwise(acc[m]).alias(m) for p, m in enumerate(levels)]
        return F.struct(*ends, F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"), F.when(inside, acc["best"]).otherwise(F.least(acc["best"], d["priority"])).alias("best"))

    start = F.struct(*[F.lit(-1).alias(m) for m in levels], F.array().cast("array<string>").alias("labels"), F.lit(len(CONFIDENCE)).alias("best"))
    verdict = F.when(gate, F.aggregate(ordered, start, step))
    confidence = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE], F.lit(0.0)), F.coalesce(F.col("_verdict.best"), F.lit(len(CONFIDENCE))) + 1)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return (
        out.withColumn("_verdict", verdict)
        .withColumn("n_words", (_blanks(F.when(norm != "  ", norm)) - 1).cast("long"))
        .withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long")))
        .withColumn("n_base", sum(places[1:], places[0]).cast("long"))
        .withColumn("first_word", F.least(*firsts).cast("long"))
        .withColumn("last_word", F.greatest(*lasts).cast("long"))
        .withColumn("base_labels", joined(some))
        .withColumn("labels", joined(F.array_union(some, F.coalesce(F.col("_verdict.labels"), F.array().cast("array<string>")))))
        .withColumn("score", F.greatest(confidence, F.when(F.size(some) > 0, 0.75).otherwise(0.0)))
        .select(*columns, *RESULTS)
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import read

    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)
