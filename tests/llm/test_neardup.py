import random
import re

import pytest

from passbook.llm import neardup
from passbook.llm.components import components


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    s = {i: sets(t, k) for i, t in rows}
    up = {i: i for i in s}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(s)
    for i in ids:
        for j in ids:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two\n")]
    for family in range(4):
        base = [word() for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(rng.choice([3, 12, 60])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(word() for _ in range(rng.randint(1, 80)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.clusters(docs, neardup.Join(k=k, percent=percent)).collect()}
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80), (1, 70)])
def test_odds_hold_at_full_depth(k, percent):
    p = neardup.Join(k=k, percent=percent)
    assert (1 - (percent / 100) ** p.depth) ** p.trees <= 1e-7


def test_single_links_at_the_threshold_in_a_large_family(spark):
    words = lambda name, n: " ".join(f"{name}x{i}" for i in range(n))
    core = words("c", 68)
    members = [f"{core} {words(f'p{i}', 2)}" for i in range(100)]
    # 70 of 100 words are those of one member; 68 of 102 those of any other
    tails = [f"{members[i]} {words(f'q{i}', 30)}" for i in range(100)]
    rows = list(enumerate(members + tails))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.clusters(docs, neardup.Join(k=1, percent=70)).collect()}
    assert got == brute(rows, 1, 70)
    assert {c for _, c, _ in got.values()} == {0}


def test_ids_that_repeat_with_other_texts(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    docs = spark.createDataFrame([(1, x), (1, y), (2, x + " e"), (3, y + " e"), (None, y), (None, "all of its own words are here"), (5, x)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.clusters(docs).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False)]
    assert sorted((r.doc_id or 0, r.text[:1]) for r in neardup.deduplicated(docs).collect()) == [(0, "a"), (1, "x"), (1, "y")]


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.clusters(docs, neardup.Join(k=3, percent=85)).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def test_deduplicated_keeps_columns_and_one_of_each(spark):
    t = "a b c d e f g h i j"
    docs = spark.createDataFrame([(3, t, "x"), (1, t.upper(), "y"), (None, "other words here now then", "z"), (2, None, None), (1, t.upper(), "y"), (2, None, None)], "doc_id long, text string, id string")
    assert sorted((r.doc_id or 0, r.id) for r in neardup.deduplicated(docs).collect()) == [(0, "z"), (1, "y"), (2, None), (2, None)]
    assert neardup.deduplicated(docs.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (200, 200), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 50, 50: 50, 70: 50}
