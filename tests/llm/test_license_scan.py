import random

import pytest
from pyspark.sql import functions as F

from framewise.llm import license_scan
from framewise.llm.license_rules import GENERAL, NAMED, NOTICE, TAG, VERSIONED, WEIGHTS, Rule, rules
from framewise.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, DOCS, docs, prose

LETTERS = set("abcdefghijklmnopqrstuvwxyz0123456789")


def words(text):
    """Words of lower-cased letters, digits and what is beyond ASCII, character by character."""
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in LETTERS or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def base(text):
    w = words(text)
    return sorted((i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def labels(text):
    _, found, detections = license_scan.scanner().scan(text)
    return sorted({x for _, x in found} | {r.label for r, _, _ in detections})


@pytest.mark.parametrize(("text", "want"), [
    ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("All rights reserved.", "reserved"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), ("Alle Rechte vorbehalten", "reserved"),
    ("Tous droits réservés.", "reserved"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-2.0", "gpl-2.0"), ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa-3.0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"), ("BSD-3-Clause", "bsd-3-clause"), ("a bsd license", "bsd"),
    ("Unauthorized copying of this file, via any medium, is strictly prohibited", "proprietary"), ("accbye-law licensees", ""),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl,gpl-3.0-or-later"),
    ("", ""), (None, ""), ("cc", ""), ("cc\nby", "cc-by"), ("ccé by cc by", "cc-by"), ("lgplv3 and gplv2", "gpl-2.0,lgpl-3.0"),
])
def test_known_texts(text, want):
    assert ",".join(labels(text)) == want


def test_there_are_hundreds_of_rules_and_their_keywords_never_hide_a_match():
    found = rules()
    assert len(found) > 300 and len({r.name for r in found}) == len(found)
    own = license_scan.scanner()
    r = random.Random(3)
    for n, rule in enumerate(found):
        assert rule.priority in WEIGHTS
        for _ in range(3):
            text = sample(rule.pattern, r)
            assert own.patterns[n].search(f" {license_scan._bytes(text)} "), (rule, text)
            assert license_scan._bytes(rule.keyword) in license_scan._bytes(text), (rule, text)


def sample(pattern, r):
    """A text that the pattern describes."""
    import re._parser as parser

    def one(parts):
        out = ""
        for op, arg in parts:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                kind, value = r.choice(arg)
                out += "x" if str(kind) in ("CATEGORY", "NEGATE") else chr(value if str(kind) == "LITERAL" else r.randint(*value))
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(one(arg[2]) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 3))))
            elif op == "SUBPATTERN":
                out += one(arg[3])
            elif op == "BRANCH":
                out += one(r.choice(arg[1]))
            else:
                raise AssertionError(op)
        return out

    return one(parser.parse(pattern))


def stands(spans, priority):
    """The same decision, span by span against all others."""
    order = sorted(spans, key=lambda s: (priority[s[2]], s[0], -s[1], s[2]))
    kept = []
    for a, b, n in order:
        stronger = any(priority[m] < priority[n] and a < d and c < b for c, d, m in kept)
        inside = any(priority[m] == priority[n] and c <= a and b <= d for c, d, m in kept)
        if not stronger and not inside:
            kept.append((a, b, n))
    return sorted(kept)


def test_overlaps_against_all_pairs():
    r = random.Random(1)
    own = license_scan.Scanner([Rule(str(i), str(i), r.choice([TAG, NOTICE, VERSIONED, NAMED, GENERAL]), "x", "x") for i in range(12)])
    priority = [rule.priority for rule in own.rules]
    for _ in range(300):
        spans = list({(a := r.randint(0, 60), a + r.randint(1, 20), r.randrange(12)) for _ in range(r.randint(0, 25))})
        assert own.resolve(spans) == stands(spans, priority)


def test_whole_texts_against_plain_search():
    r, own = random.Random(2), license_scan.scanner()
    phrases = ["cc by", "CC-BY-SA 4.0", "GNU General Public License v2", "All rights reserved", "mit license", "Copyright (c) 2020", "é", "licensed under the", *(sample(x.pattern, r) for x in rules()[::7])]
    for seed in range(60):
        parts = [r.choice(phrases) if r.random() < 0.4 else prose(seed * 50 + k, 6) for k in range(30)]
        text = r.choice([" ", "\n", ", "]).join(parts)
        n_words, found, detections = own.scan(text)
        assert n_words == len(words(text)) and found == base(text)
        body = f" {license_scan._bytes(' '.join(words(text)))} "
        everything = own.matches(body, set(range(len(own.rules))))
        plain = stands(everything, [x.priority for x in own.rules])
        place = lambda at: body[:at].count(" ") - 1
        assert [(own.rules[n].name, place(a), place(b) + 1) for a, b, n in plain] == [(x.name, a, b) for x, a, b in detections]


def test_awkward_rows(spark):
    rows = [*AWKWARD, (20, "CC BY " * 40000, "a"), (21, "▁ cc by cc by", "b"), (None, "mit license", None)]
    got = license_scan.detect(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.n_words, r.n_base) for r in got) == sorted((i or -1, len(words(t)), len(base(t))) for i, t, _ in rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[20].first_word, by_id[20].last_word, by_id[20].base_labels) == (0, 79998, ["cc-by"])
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.detections or r.base_labels) for r in got)
    assert license_scan.detect(spark.createDataFrame([], DOCS)).count() == 0


def test_query_finds_every_base_phrase(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        want = base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words(texts[r.doc_id])), len(want))
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in want})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))
    plain = [r for r in rows if not r.labels]
    assert len(plain) > len(rows) / 2 and all(r.score == 0 for r in plain)


def test_labels_column_is_sorted_bytewise(spark):
    row = spark.range(1).select(F.array_join(F.sort_array(F.array(F.lit("cc-by"), F.lit("apache"))), ",").alias("x")).first()
    assert row.x == "apache,cc-by"
