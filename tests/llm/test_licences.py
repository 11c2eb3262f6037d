from passbook.llm import licences


def test_sequences_in_order(spark):
    grant, cond, asis = (t for i, t in licences.SENTENCES if i.startswith("mit-") and i != "mit-notice")
    texts = [
        f"Intro.\n{grant}.\n{cond}. {asis.lower()}!\nEnd",
        f"{asis}.\n{cond}.\n{grant}.",
        f"{grant}.\nOne. Two. Three.\n{cond}.\n{asis}",
        f"{grant}.\n1.\n2.\n3.\n4.\n{cond}.\n{asis}",
        "Words. Licensed under the Apache License, Version 2.0.\nReleased under the MIT  License",
        None,
        "",
        "x" * 100_000 + " " + "Licensed under CC BY-NC 4.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n http://www.apache.org/licenses/LICENSE-2.0',
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, licence string")
    got = sorted(tuple(r) for r in licences.scan(docs, *licences.known_rules(spark)).collect())
    assert got == [
        (0, "mit-text", "MIT", 1, 3),
        (2, "mit-text", "MIT", 0, 5),
        (4, "apache-2.0-notice", "Apache-2.0", 1, 1),
        (4, "mit-notice", "MIT", 2, 2),
        (8, "apache-2.0-notice", "Apache-2.0", 0, 0),
    ]
    assert licences.scan(docs.limit(0), *licences.known_rules(spark)).collect() == []


def test_longest_rule_wins_and_odd_rules(spark):
    sentences = spark.createDataFrame([("a", "One."), ("b", "Two"), (None, "Three"), ("c", None)], "id string, text string")
    rules = spark.createDataFrame([("ab", "AB", ["a", "b"]), ("a", "A", ["a"]), ("none", "N", None), ("void", "V", []), ("null", "X", [None])], "rule string, licence string, ids array<string>")
    docs = spark.createDataFrame([(1, "one. zero. TWO! one."), (1, "one. zero. TWO! one.")], "doc_id long, text string")
    got = sorted(tuple(r) for r in licences.scan(docs, sentences, rules).collect())
    assert got == [(1, "a", "A", 3, 3)] * 2 + [(1, "ab", "AB", 0, 2)] * 2
    assert licences.scan(docs, sentences.limit(0), rules.limit(0)).collect() == []


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

(2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_official_wrapped_texts(spark):
    bare = [APACHE, MIT, BSD, GPL]
    marked = ["\r\n".join(f" * {line}" for line in x.split("\n")) for x in bare]
    lines = "Some words\nLicensed under CC BY 4.0\nReleased under the MIT License\nmore words"
    docs = spark.createDataFrame(list(enumerate([*bare, *marked, lines, "*" * 500 + " " + MIT])), "doc_id long, text string")
    rows = licences.scan(docs, *licences.known_rules(spark)).collect()
    names = ["apache-2.0-header", "mit-text", "bsd-2-clause-text", "gpl-3.0-header"]
    want = [*enumerate(names), *enumerate(names, 4), (8, "cc-by-4.0-notice"), (8, "mit-notice"), (9, "mit-text")]
    assert sorted((r.doc_id, r.rule) for r in rows) == want
    assert [(r.first, r.last) for r in rows if r.doc_id in (0, 3)] == [(1, 4), (0, 1)]


def test_every_reachable_position(spark):
    sentences = spark.createDataFrame([(x, x) for x in "abc"], "id string, text string")
    rules = spark.createDataFrame([("abc", "X", ["a", "b", "c"])], "rule string, licence string, ids array<string>")
    docs = spark.createDataFrame([(1, "a. b. x. b. x. c. x.")], "doc_id long, text string")
    assert [tuple(r) for r in licences.scan(docs, sentences, rules, 2).collect()] == [(1, "abc", "X", 0, 5)]


def test_banners_blanks_and_many_notices(spark):
    import time

    notice = "Released under the MIT License."
    texts = ["*" * 90 + " " + notice, "Released under" + " " * 3000 + "the MIT License.", "\n".join([notice] * 100_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = licences.scan(docs, *licences.known_rules(spark)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {0: 1, 1: 1, 2: 100_000}
    assert time.time() - began < 60


def test_longest_equals_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(300):
        met = []
        for _ in range(rng.randrange(12)):
            first = rng.randrange(20)
            met.append(("r", "l", first, first + rng.randrange(4), rng.randint(1, 3)))
        want = [x[:4] for x in met if not any(f <= x[3] and x[2] <= t and k > x[4] for _, _, f, t, k in met)]
        assert sorted(licences._longest(met)) == sorted(want)


BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""


def test_each_official_text_gives_its_licence_alone(spark):
    texts = {
        "Apache-2.0": APACHE, "MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD3, "GPL-3.0": GPL, "GPL-2.0-or-later": GPL2, "LGPL-2.1": LGPL21,
        "LGPL-3.0": GPL.replace("General", "Lesser General"), "AGPL-3.0": GPL.replace("General", "Affero General"), "MPL-2.0": MPL, "ISC": ISC,
        "GPL-2.0-only": "// SPDX-License-Identifier: GPL-2.0-only\nint main;", "BSL-1.0": "/* SPDX-License-Identifier: BSL-1.0 */",
    }
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts.values())], "doc_id long, text string")
    rows = licences.scan(docs, *licences.known_rules(spark)).collect()
    assert sorted((r.doc_id, r.licence) for r in rows) == list(enumerate(texts))


def naive(ids, rules, gap):
    """Of a text whose sentences have these identifiers (None: not known) the (rule, first, last) that are met, by trying every way."""
    met = []
    for name, rule in rules:
        def ends(at, left):
            if not left:
                return {at}
            return {e for k in range(at + 1, min(len(ids), at + gap + 2)) if ids[k] == left[0] for e in ends(k, left[1:])}

        over = -1
        for i, x in enumerate(ids):
            if x == rule[0] and i > over and (found := ends(i, rule[1:])):
                over = min(found)
                met.append((name, i, over, len(rule)))
    return sorted(m[:3] for m in met if not any(o[3] > m[3] and o[1] <= m[2] and m[1] <= o[2] for o in met))


def test_scan_equals_trying_every_way(spark):
    import random

    rng = random.Random(8)
    rules = [("r1", ["a"]), ("r2", ["a", "b"]), ("r3", ["b", "a", "c"]), ("r4", ["c", "c"]), ("r5", ["a", "b", "a", "b"])]
    texts = [[rng.choice(["a", "b", "c", None, None]) for _ in range(rng.randint(0, 14))] for _ in range(300)]
    names = {"a": "Alpha one", "b": "Beta", "c": "Gamma, ray"}
    docs = spark.createDataFrame([(i, " ".join(f"{names.get(x, 'Other words')}." for x in t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sentences = spark.createDataFrame(list(names.items()), "id string, text string")
    table = spark.createDataFrame([(r, r.upper(), ids) for r, ids in rules], "rule string, licence string, ids array<string>")
    for gap in (0, 2):
        got = sorted((r.doc_id, r.rule, r.first, r.last) for r in licences.scan(docs, sentences, table, gap).collect())
        assert got == sorted((i, *m) for i, t in enumerate(texts) for m in naive(t, rules, gap))
