"""The keyword gate of the license scan: rules run on every text that their expressions match."""

import re

import pytest

pytest.importorskip("candlemill.llm")
from candlemill.llm import common, license_scan  # noqa: E402


def branches(pattern):
    """Texts that an expression matches: one for each choice of its alternatives and optional parts."""
    out, at = [""], 0
    while at < len(pattern):
        if pattern.startswith("(?:", at):
            depth, end, cuts = 1, at + 3, [at + 3]
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                if pattern[end] == "|" and depth == 1:
                    cuts.append(end + 1)
                end += 1
            inner = [t for a, b in zip(cuts, [*[c - 1 for c in cuts[1:]], end - 1], strict=True) for t in branches(pattern[a:b])]
            at = end
        elif pattern[at] == "[":
            end = pattern.index("]", at)
            inner = [pattern[at + 1]] if pattern[at + 2] == "-" else list(pattern[at + 1 : end])
            at = end + 1
        else:
            inner, at = [pattern[at]], at + 1
        if at < len(pattern) and pattern[at] == "{":
            inner, at = [x * int(pattern[at + 1]) for x in inner], at + 3
        elif at < len(pattern) and pattern[at] in "?*":
            inner, at = ["", *inner], at + 1
        out = [a + b for a in out for b in inner]
    return out


def test_keywords_are_in_all_matches():
    gates = set(license_scan.gate_words())
    for keywords, pattern, _, _ in license_scan.rules():
        for text in branches(pattern):
            assert re.fullmatch(pattern, text), (pattern, text)
            assert any(f" {k} " in f" {text} " for k in keywords.split("|")), (keywords, text)
            assert gates & set(text.split()), text


def test_texts_that_the_gate_kept_out(spark):
    common.prepare(spark)
    texts = {
        "Licensed under the General Public License, version 3": "gpl-3",
        "All rights are reserved.": "reserved",
        "It contains trade secrets of ours": "proprietary",
        "Creative Commons Zero 1.0 Universal": "cc0",
        "the Do What The Fuck You Want To Public License": "wtfpl",
    }
    texts |= {
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0": "cc-by-nc-sa-4.0",
        "see https://creativecommons.org/licenses/by-nd/3.0/": "cc-by-nd-3.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.": "apache-2.0",
        "Redistributions of source code must retain the above copyright notice": "bsd",
        "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "license = Apache-2.0": "apache-2.0",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl-3",
    }
    silent = ["a python license debate", "an apache tribe", "the word mit is German for with", "gnu and free beer", "creative people of the commons"]
    none = license_scan.scan(spark.createDataFrame([(t,) for t in silent], "text string")).collect()
    assert {r.text: r.labels for r in none} == dict.fromkeys(silent, "")
    strict = license_scan.scan(spark.createDataFrame([("Creative Commons Attribution-NonCommercial-ShareAlike 4.0",)], "text string")).first()
    assert strict.labels == "cc-by-nc-sa-4.0", "the parts of a name grant nothing of their own"
    got = {r.text: r.labels.split(",") for r in license_scan.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert {t: v in got[t] for t, v in texts.items()} == dict.fromkeys(texts, True)


def test_base_columns_by_brute_force(spark):
    import random

    rng = random.Random(4)
    bits = ["CC BY", "cc  by", "cc by cc by", "General Public License", "all rights reserved", "all rights", "ccby", "é", "x", "\n", "cc-by", "Licence", "reserved", "ALL RIGHTS, RESERVED"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(150)] + [None, "", " ", "cc by " * 4000]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = common.WORD.findall((texts[r.doc_id] or "").translate(common.ASCII_LOWER))
        places, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES:
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, texts[r.doc_id]
        assert labels <= set(r.labels.split(",")) or not labels
