import random
import re
from unittest import mock

from panelspark.llm import licenses
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    words = WORD.findall(lower(text))
    base = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    joined = " " + " ".join(words) + " "
    found = []
    for number, label, keyword, expr, tier, conf in licenses.rules():
        if f" {keyword} " not in joined:
            continue
        for m in re.finditer(f"(?<= )(?:{expr})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((start, start + len(m[0].split()), label, tier, conf, number))
    stay = [d for d in found if not any(o is not d and o[3] >= d[3] and o[0] <= d[0] and o[1] >= d[1] and ((o[0], -o[1], -o[3], o[5]) < (d[0], -d[1], -d[3], d[5])) for o in found)]
    labels = {x[1] for x in base} | {d[2] for d in stay}
    score = max([1.0] * bool(base) + [d[4] for d in stay], default=0.0)
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x[1] for x in base})), ",".join(sorted(labels)), score, sorted(d[:5] for d in stay)


TEXTS = [
    None, "", "  ", "no law here", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC-BY, cc by; CC BY 4.0!",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved. all\nRights_reserved", "ALL RIGHTS RESERVEDx",
    "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: BSD-3-Clause", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "K general public license İ cc by", "the General Public License general public license", "occ by cc bye cc", "cc by " * 400, "Mozilla Public License 2.0 and creative commons attribution share alike 3.0",
    "this is in the public domain, without warranty of any kind. Copyright (c) 2020", "é" * 3000 + " cc by", "published under the Eclipse Public License 2.0 (EPL)",
]


def test_against_brute_force(spark):
    rnd = random.Random(9)
    mixed = [" ".join(rnd.choice(TEXTS[4:17] + ["the", "Licence", "gnu", "cc", "by", "sa", "2.0", "version"]) for _ in range(rnd.randint(2, 8))) for _ in range(60)]
    texts = TEXTS + mixed
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, TEXTS[3]), (None, TEXTS[4])], "doc_id long, text string").withColumns({"label": F.lit("x"), "score": F.lit("clash")})
    got = licenses.scan(docs, "text").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute(texts[r.doc_id] if r.doc_id is not None else TEXTS[4])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want[:7], texts[r.doc_id or 4]
        assert [tuple(d) for d in r.detections or []] == want[7]


def test_many_rules_and_empty_table(spark):
    assert len(licenses.rules()) > 400 and len({r[3] for r in licenses.rules()}) > 400
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), "text").collect() == []


def forms(expr):
    """Texts that match an expression: every alternative stands in one of them, and what is optional only in the last."""
    from re import _constants as c
    from re import _parser

    def seq(parts):
        each = [one(*p) for p in parts]
        n = max(map(len, each), default=1)
        return ["".join(e[min(k, len(e) - 1)] for e in each) for k in range(n)]

    def one(op, arg):
        if op is c.LITERAL:
            return [chr(arg)]
        if op is c.IN:
            return [chr(arg[0][1]) if arg[0][0] is c.LITERAL else chr(arg[0][1][0]) if arg[0][0] is c.RANGE else "a"]
        if op is c.BRANCH:
            return [t for b in arg[1] for t in seq(b)]
        if op is c.SUBPATTERN:
            return seq(arg[3])
        assert op is c.MAX_REPEAT, op
        return ["a"] if arg[1] is c.MAXREPEAT else ["", *seq(arg[2])]

    found = seq(_parser.parse(expr))
    assert all(re.fullmatch(expr, t) for t in found), expr
    return found


ALONE = ["Copyright (c) 2021 Acme", "Built with Apache 2.0", "released under the MIT", "BSD 3-Clause", "Mozilla MPL 2.0", "SIL Open Font 1.1"]


def test_gate_lets_each_rule_pass(spark):
    texts = [(k, keyword, t) for k, _, keyword, expr, _, _ in licenses.rules() for t in forms(expr) if keyword in t.split()]
    assert {k for k, _, _ in texts} >= {r[0] for r in licenses.rules() if not r[3].startswith("you may not use")}
    df = spark.createDataFrame(texts, "rule int, keyword string, t string").withColumn("gate", licenses.keywords_in(F.split("t", " ")))
    tried = df.withColumn("hit", licenses.hits(F.concat(F.lit(" "), F.col("t"), F.lit(" ")), F.col("gate")))
    assert tried.filter("NOT array_contains(gate, keyword) OR NOT array_contains(hit, keyword)").collect() == []
    none = spark.createDataFrame([("occ apaches émit bsd2 copyrighté",)], "t string").select(licenses.keywords_in(F.split("t", " "))).first()[0]
    assert none == []


def test_notices_alone(spark):
    got = licenses.scan(spark.createDataFrame(list(enumerate(ALONE)), "doc_id long, text string"), "text").collect()
    assert {r.doc_id: r.labels for r in got} == {0: "copyright", 1: "apache-2.0", 2: "mit", 3: "bsd-3-clause", 4: "mpl-2.0", 5: "ofl-1.1"}
    assert all(r.labels == brute(ALONE[r.doc_id])[5] for r in got)


NOTICES = {  # written out here, apart from the rules
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache-2.0",
    "This code is GPLv3.": "gpl-3.0",
    "MIT License": "mit",
    "under a 3-clause BSD license": "bsd-3-clause",
    "See http://www.gnu.org/licenses/gpl-3.0.html": "gpl-3.0",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    "CC BY-NC-ND 4.0": "cc-by,cc-by-nc-nd-4.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1",
    "This program is free software; you can redistribute it and/or modify it": "gpl",
    "Business Source License 1.1": "busl-1.1",
    "released under the terms of the GNU Affero General Public License version 3": "agpl-3.0,gpl",
    "proprietary and confidential. Copyright (c) 1999 X": "copyright,proprietary",
    "mitigate the bsdish zlibs": "",
}


def test_notices_written_out(spark):
    got = {r.text: r.labels for r in licenses.scan(spark.createDataFrame([(t, t) for t in NOTICES], "text string, t string"), "t").collect()}
    assert got == NOTICES


def test_own_names_as_columns(spark):
    docs = spark.createDataFrame([(1, "MIT License", *"abcdefghijk")], "doc_id long, text string, __words string, __keywords string, __row string, rule string, label string, words string, hit string, keyword string, expr string, start string, labels string")
    got = licenses.scan(docs, "text").first().asDict()
    assert got["labels"] == "mit" and [got[c] for c in ("__words", "__keywords", "__row", "rule", "label", "words", "hit", "keyword", "expr", "start")] == list("abcdefghij")


def every_rule(text):
    """Brute force without the gate of keywords, but for the Apache notice, which hangs on a word outside it."""
    first = (WORD.findall(lower(text)) or [""])[0]
    free = [(n, label, k if expr.startswith("you may not use") else first, expr, *rest) for n, label, k, expr, *rest in licenses.rules()]
    with mock.patch.object(licenses, "rules", lambda: free):
        return brute(text)


LONG_NAMES = {
    "GNU Library General Public License version 2": "gpl,lgpl-2.0", "Common Development and Distribution License 1.0": "cddl-1.0", "European Union Public Licence 1.2": "eupl-1.2",
    "do what the fuck you want to public": "wtfpl", "Creative Commons Zero": "cc0", "you may not use this file except in compliance with the license": "apache", "Apache: you may not use this file except in compliance with the License": "apache",
}


def test_every_alternative_matches_by_itself(spark):
    texts = [*LONG_NAMES, *dict.fromkeys(t for *_, expr, _, _ in licenses.rules() for t in forms(expr))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text").collect()}
    assert [got[k].labels for k in range(len(LONG_NAMES))] == list(LONG_NAMES.values())
    for k, t in enumerate(texts):
        want = every_rule(t)
        assert (got[k].labels, got[k].score, [tuple(d) for d in got[k].detections or []]) == want[5:], t


def test_words_that_name_other_things(spark):
    """A bare name counts beside a word of licensing only; the sentence of a header counts by itself."""
    texts = {"I went to the Apache reservation": "", "the MPL of BSD Zlib": "", "the license of Apache": "apache", "Apache, as a license": "apache", "under the usual BSD": "bsd", "you may not use this file except in compliance with the License": "apache"}
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("copy", F.col("text"))
    assert {r["copy"]: r.labels for r in licenses.scan(docs, "text").collect()} == texts
