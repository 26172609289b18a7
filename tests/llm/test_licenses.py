import random
import re
import re._parser as sre

from palimpsest.llm import licenses as L

from .tools import LOWER, ODD, documents, odd_columns

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return W.findall((text or "").translate(LOWER))


def brute(text):
    w = words(text)
    at = [(i, label) for i in range(len(w)) for p, label in L.PHRASES if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def brute_labels(text):
    """Every rule searched everywhere, without keywords; each detection held against each other one."""
    norm = " " + " ".join(words(text)) + " "
    found = [(m.start(), m.end(), p, n, label) for n, (_, p, label, r) in enumerate(L.rules()) for m in re.finditer(r, norm)]

    def gone(x):
        for y in found:
            within = y[0] <= x[0] and x[1] <= y[1]
            if within and (y[2] < x[2] or y[2] == x[2] and (y[:2] != x[:2] or y[3] < x[3])) or y[2] < x[2] and y[0] < x[1] and x[0] < y[1]:
                return True
        return False

    left = [x for x in found if not gone(x) and x[4] != "-"]
    base = {label for p, label in L.PHRASES if f" {p} " in norm}
    return ",".join(sorted({x[4] for x in left} | base)), max((L.CONFIDENCE[x[2]] for x in left), default=0.0)


def samples(regex):
    """Strings that a regex fits: each alternative and each end of each repeat at least once."""

    def go(tree):
        out = [""]
        for op, arg in tree:
            if op is sre.LITERAL:
                part = [chr(arg)]
            elif op is sre.IN:
                part = [chr(a if o is sre.LITERAL else a[0]) for o, a in arg]
            elif op is sre.SUBPATTERN:
                part = go(arg[3])
            elif op is sre.BRANCH:
                part = [x for b in arg[1] for x in go(b)]
            elif op is sre.MAX_REPEAT:
                one = go(arg[2])
                part = (one if arg[0] else [""]) if arg[1] == 1 and arg[0] else [""] * (arg[0] == 0) + one if arg[1] == 1 else ["".join(one[:1] * arg[0]), *[x * max(1, arg[0]) for x in one]]
            else:
                part = [""]
            n = max(len(out), len(part))
            few = len(out) * len(part) <= 40
            out = [a + b for a in out for b in part] if few else [out[i % len(out)] + part[i % len(part)] for i in range(n)]
        return out

    return [x for x in go(sre.parse(regex.removesuffix("(?= )"))) if re.fullmatch(regex + " ", x + " ")]


def test_base(spark):
    rng = random.Random(3)
    parts = ["MIT License", "mit-license", "CC  BY", "cc.by", "cc", "by", "GNU General\nPublic License", "gnu", "apache", "license", "Apache License,", "é", "A", "x1", "—", "accby", "mit license mit license"]
    texts = {i: " ".join(rng.choices(parts, k=rng.randint(0, 30))) for i in range(200)}
    for r in L.scan(documents(spark, texts)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_labels_against_brute_force(spark):
    rng = random.Random(5)
    rules = L.rules()
    texts = {i: rng.choice(["", "Note: ", "It is not "]) + rng.choice([" ", ", ", "\n# "]).join(" ".join(rng.choice(samples(rng.choice(rules)[3]) or [""]).split()) + rng.choice(["", " and", " license", " or"]) for _ in range(rng.randint(1, 5))) for i in range(400)}
    texts |= {1000 + i: rng.choice(samples(r[3])).upper() for i, r in enumerate(rules)}
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(documents(spark, texts)).collect()}
    for i, text in texts.items():
        assert got[i] == brute_labels(text), text


def test_labels(spark):
    texts = {
        1: "This work is licensed under the GNU General Public License, version 3.", 2: "Licensed under CC BY-NC 4.0.", 3: "Licensed under the GNU Lesser General Public License.",
        4: "SPDX-License-Identifier: MPL-2.0", 5: "No grant here.", 6: "All rights reserved.", 7: "Mozilla Public License 2.0 and the BSD 3-Clause License",
        8: "Licensed under Creative Commons Attribution-ShareAlike 4.0", 9: "Not licensed under the Mozilla Public License.", 10: "See https://www.apache.org/licenses/LICENSE-2.0.html",
        11: "https://creativecommons.org/licenses/by-nc-sa/4.0/", 12: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        13: "This library is GPL-3.0 compatible with the Apache License.", 14: "The Expat licence", 15: "mit freundlichen Grüßen, lizenziert wird nichts",
    }
    got = {r.doc_id: r.labels for r in L.scan(documents(spark, texts)).collect()}
    assert got == {
        1: "gpl", 2: "cc-by,cc-by-nc", 3: "lgpl", 4: "mpl", 5: "", 6: "proprietary", 7: "bsd-3-clause,mpl", 8: "cc-by-sa", 9: "", 10: "apache", 11: "cc-by-nc-sa", 12: "bsd", 13: "apache,gpl", 14: "mit", 15: "",
    }


def test_every_rule_is_reached_through_its_keyword_and_the_gate():
    assert len(L.rules()) >= 250
    for keyword, priority, _, regex in L.rules():
        found = samples(regex)
        assert found and 0 <= priority < len(L.CONFIDENCE)
        for x in found:
            assert keyword in x + " ", (keyword, x)
            for text in (x.strip(), x.strip().upper(), re.sub(" ", ".\n * ", x.strip())):
                assert re.search(L.gate(), text + "."), text
    assert all(re.search(L.gate(), p) for p, _ in L.PHRASES)


def test_odd_rows(spark):
    rows = L.scan(odd_columns(documents(spark, ODD))).collect()
    assert len(rows) == len(ODD)
    assert all((r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0) for r in rows if r.doc_id in (1, 2, 3))
    long = documents(spark, {1: "see the MIT License now. " * 3000})
    assert L.scan(long).first().n_base == 3000
    assert L.scan(documents(spark, {})).count() == 0


def test_names_notices_and_bodies(spark):
    texts = {
        1: "Under the GNU Public License.", 2: "the Expat License", 3: "Berkeley Software Distribution License", 4: "Internet Systems Consortium License",
        5: "Released under GPLv3.", 6: "Licensed under Apache 2.0", 7: "Distributed under the MIT.", 8: "GNU AGPL v3 or later", 9: "available under BSD-3-Clause",
        10: "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated documentation files (the \"Software\")",
        11: "Redistribution and use in source and binary forms, with or without modification, are permitted", 12: "Available under many names, he met a gpl fan at MIT.",
        13: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", 14: "LGPL-2.1+", 15: "MPL-2.0",
    }
    got = {r.doc_id: r.labels for r in L.scan(documents(spark, texts)).collect()}
    assert got == {1: "gpl", 2: "mit", 3: "bsd", 4: "isc", 5: "gpl", 6: "apache", 7: "mit", 8: "agpl", 9: "bsd-3-clause", 10: "mit", 11: "bsd", 12: "", 13: "isc", 14: "lgpl", 15: "mpl"}
