"""Licence scans by sentence rules.

A text's lines are cut to pieces at sentence ends. A known sentence is met where the words of one piece or of
several that follow each other are its words, however its lines are wrapped; it becomes an identifier. A licence's rule is an ordered list of identifiers. It is found where the identifiers occur
in that order among the known sentences of a text, with at most `gap` other sentences between
two of them. Sentences and rules are tables of bounded size that travel with the tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the rules and sentences that may travel with the tasks.
MOST_RULES = 100_000

# fixed values: identifiers of licence sentences, and their wordings
SENTENCES = [
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache-comply", "you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-notice", "Licensed under CC BY 4.0"),
    ("cc0-notice", "Released under CC0 1.0"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
]

# fixed values: whole official sentences that go on where those above end
OFFICIAL = [
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("bsd-name", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-name", "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("lgpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl2-subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-asis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("unlicense-free", "This is free and unencumbered software released into the public domain"),
]

# fixed values: identifiers that a line of its own may name
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()

# fixed values: rules as (rule, licence, identifiers in order)
RULES = [
    ("apache-2.0-notice", "Apache-2.0", ["apache-notice"]),
    ("apache-2.0-header", "Apache-2.0", ["apache-notice", "apache-comply", "apache-copy", "apache-asis"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("mit-text", "MIT", ["mit-grant", "mit-condition", "mit-asis"]),
    ("gpl-3.0-notice", "GPL-3.0", ["gpl3-notice"]),
    ("gpl-3.0-header", "GPL-3.0", ["gpl-free", "gpl-hope"]),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("cc-by-4.0-notice", "CC-BY-4.0", ["cc-by-notice"]),
    ("cc0-1.0-notice", "CC0-1.0", ["cc0-notice"]),
    ("bsd-2-clause-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-3-clause-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("gpl-2.0-or-later-header", "GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("gpl-2.0-only-header", "GPL-2.0-only", ["gpl2-only"]),
    ("lgpl-2.1-header", "LGPL-2.1", ["lgpl21-free", "lgpl-hope"]),
    ("lgpl-3.0-header", "LGPL-3.0", ["lgpl3-free", "gpl-hope"]),
    ("agpl-3.0-header", "AGPL-3.0", ["agpl3-free", "gpl-hope"]),
    ("mpl-2.0-header", "MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("isc-text", "ISC", ["isc-grant", "isc-asis"]),
    ("unlicense-text", "Unlicense", ["unlicense-free"]),
]

#: Pieces end at a line's end, or at one of .!?; before a blank; "4.0" inside a line doesn't matter to known sentences.
_LINES = re.compile(r"\r\n?|\n")
_ENDS = re.compile(r"(?<=[.!?;])\s")
_WORD = re.compile(r"\w+")
#: A list item opens a line; its mark in brackets isn't part of the sentence.
_ITEM = re.compile(r"\s*(?:[-\u2022](?!-)|\(?\w{1,3}[.)](?:\s|$))")
_MARK = re.compile(r"\W*\w{1,3}\)\s+")


def normalised(sentence: str) -> str:
    """Lower-case words of letters, digits and underscores with single blanks between them."""
    return " ".join(_WORD.findall(sentence.lower()))


def _pieces(text: str) -> list[tuple[str, bool]]:
    """(piece, whether a sentence may go on into it from the line before); pieces without words are left out like blank lines."""
    out: list[tuple[str, bool]] = []
    open_ = False
    for line in _LINES.split(text):
        goes_on = open_ and not _ITEM.match(line)
        open_ = False
        for s in _ENDS.split(line):
            if _WORD.search(s):
                s = s.strip()
                out.append((s, goes_on))
                open_ = s[-1] not in ".!?;:"
                goes_on = False
    return out


def _known(pieces: list[tuple[str, bool]], known: dict[str, str], ordered: list[str], starts: set[str], most: int) -> list[tuple[int, int, str]]:
    """(first piece, last piece, identifier) of the places whose words are those of a known sentence; most: its words at most."""
    out = []

    def words(s: str) -> list[str]:
        return [m.group() for m in islice(_WORD.finditer(s.lower()), most + 1)]

    for i, (s, _) in enumerate(pieces):
        if _WORD.search(s).group().lower() not in starts:
            # few pieces begin with a word that a known sentence begins with
            mark = _MARK.match(s)
            if mark is None and s.isascii():
                continue
            s = s[mark.end() :] if mark else s
            if next(iter(words(s)), None) not in starts:
                continue
        so_far, j = " ".join(words(s)), i
        while True:
            if so_far in known:
                out.append((i, j, known[so_far]))
            j += 1
            so_far += " "
            at = bisect_left(ordered, so_far)
            if j == len(pieces) or at == len(ordered) or not ordered[at].startswith(so_far):
                break
            so_far += " ".join(words(pieces[j][0]))
    return out


def _numbers(pieces: list[tuple[str, bool]], met: list[tuple[int, int, str]]) -> list[int]:
    """The number of each piece's sentence: known ones are one each, other lines that go on are one with the line before."""
    inside = {k for i, j, _ in met for k in range(i + 1, j + 1)}
    edge = {i for i, _, _ in met} | {j + 1 for _, j, _ in met}
    out, n = [], -1
    for k, (_, goes_on) in enumerate(pieces):
        if k not in inside and (k in edge or not goes_on):
            n += 1
        out.append(n)
    return out


def _find(met: list[tuple[int, int, str]], number: list[int], rule: list[str], gap: int) -> list[tuple[int, int]]:
    """Non-overlapping (first, last) pieces where the rule's identifiers follow each other; met is in order of its first pieces."""
    out: list[tuple[int, int]] = []
    for at, (first, end, i) in enumerate(met):
        if i != rule[0] or (out and first <= out[-1][1]):
            continue
        # every piece in which the identifiers so far can end
        ends = {end}
        for x in rule[1:]:
            far = max(number[e] for e in ends) + gap + 1
            after: set[int] = set()
            for f, e, y in islice(met, at + 1, None):
                if number[f] > far:
                    break
                if y == x and any(f > b and number[f] - number[b] <= gap + 1 for b in ends):
                    after.add(e)
            ends = after
            if not ends:
                break
        if ends:
            out.append((first, min(ends)))
    return out


def _longest(met: list[tuple[str, str, int, int, int]]) -> Iterator[tuple[str, str, int, int]]:
    """Of places (rule, licence, first, last, sentences) those that share no piece with one of more sentences."""
    firsts: list[int] = []
    far: list[int] = []  # of the places so far by their first pieces: the furthest last piece up to each
    for size in sorted({x[4] for x in met}, reverse=True):
        own = [x[:4] for x in met if x[4] == size]
        for x in own:
            at = bisect_right(firsts, x[3])
            if not at or far[at - 1] < x[2]:
                yield x
        spans = sorted([*((f, l) for _, _, f, l in own), *zip(firsts, far)])
        firsts, far = [f for f, _ in spans], list(accumulate((l for _, l in spans), max))


def scan(docs: DataFrame, sentences: DataFrame, rules: DataFrame, gap: int = 3) -> DataFrame:
    """docs(doc_id, text): (doc_id, rule, licence, first, last) of each place where a rule is met.

    sentences(id, text) and rules(rule, licence, ids array<string>) are checked to hold at most
    MOST_RULES rows. first and last number a text's sentences from 0. Among rules met at places
    that share a sentence only those with the most sentences stay. Null and empty texts have no sentences;
    rows that repeat a document repeat its rows, and other columns are left out. Rules with no or null ids are ignored;
    rules with equally many sentences that share some are all given.
    A line that goes on in the next one ends no sentence, but for the lines of known sentences.
    """
    spark = docs.sparkSession
    for df in (sentences, rules):
        if df.limit(MOST_RULES + 1).count() > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rows of rules")
    known = {normalised(r.text): r.id for r in sentences.where("text is not null and id is not null").orderBy(F.desc("id")).collect()}
    known.pop("", None)
    all_rules = sorted((r.rule, r.licence, list(r.ids)) for r in rules.collect() if r.ids and None not in r.ids)
    shared = spark.sparkContext.broadcast((known, all_rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, all_rules = shared.value
        starts = {k.split(" ", 1)[0] for k in known}
        ordered, most = sorted(known), max((k.count(" ") + 1 for k in known), default=0)
        by_first: dict[str, list] = {}
        for r in all_rules:
            by_first.setdefault(r[2][0], []).append(r)
        for whole in batches:
            for lo in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(lo, 512)
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    pieces = _pieces(text or "")
                    ids = _known(pieces, known, ordered, starts, most)
                    if not ids:
                        continue
                    number = _numbers(pieces, ids)
                    met = [(r, l, *span, len(i)) for x in sorted({x for _, _, x in ids}) for r, l, i in by_first.get(x, []) for span in _find(ids, number, i, gap)]
                    for r, l, first, last in _longest(met):
                        for c, v in zip(out, (doc, r, l, number[first], number[last])):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "rule", "licence", "first", "last"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, rule string, licence string, first int, last int")


def known_rules(spark) -> tuple[DataFrame, DataFrame]:
    lines = [(f"spdx-{x}", f"SPDX-License-Identifier: {x}") for x in SPDX]
    named = [(f"spdx-{x}", x, [f"spdx-{x}"]) for x in SPDX]
    return spark.createDataFrame(SENTENCES + OFFICIAL + lines, "id string, text string"), spark.createDataFrame(RULES + named, "rule string, licence string, ids array<string>")
