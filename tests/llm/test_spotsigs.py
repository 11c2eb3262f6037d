import hashlib
import random

import pytest

from passbook.llm import spotsigs


def sets(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    from pyspark.sql import functions as F

    return [r.s for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).orderBy("doc_id").collect()]


def test_chains_follow_anchors(spark):
    a, b, c, d, e, f, g = sets(spark, ["The cat, of the mat sat", "the CAT mat.  the mat sat", "cat mat sat", "cat mat", None, "", "!?"])
    # anchors in between are skipped; a run of anchors counts as its last
    assert set(a) == set(b) and len(a) == 2
    assert len(c) == 1 and len(d) == 1 and c != d
    assert e == f == g


def test_long_runs(spark):
    runs = ["the " * 50_000 + "cat mat", "cat " + "of the " * 50_000 + "mat the hat", "word " * 50_000, "x" * 300_000]
    assert [len(s) for s in sets(spark, runs)] == [1, 1, 1, 1]


def brute(rows):
    order = sorted(((i if i is not None else -(2**63), t or "") for i, t in rows), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        n = len(t)
        nxt = order[(k + 1) % len(order)][1]
        out.append((i, n, hashlib.sha256((t[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest()))
    return sorted(out)


def test_edited_texts_equal_brute_force(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["the", "of", "é", "und", "cat", "mat", "x🎉y", "sat", "hat"]) for _ in range(rng.randint(0, 60)))
    rows = [(i * rng.choice([1, 1, 1, 1000]), text()) for i in range(300)] + [(None, "null id é"), (7_000_000_000, None), (7_000_000_001, "")]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spotsigs.edited_fingerprints(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -(2**63), r.n_chars, r.edited_sha256) for r in got) == brute(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = spotsigs.edited_fingerprints(docs.where("doc_id is null")).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 9)]
    assert spotsigs.edited_fingerprints(docs.limit(0)).collect() == []
    twice = spotsigs.edited_fingerprints(docs.where("doc_id = 7000000001").union(docs.where("doc_id = 7000000001"))).collect()
    assert [r.near_next for r in twice] == [1.0, 1.0]


@pytest.mark.parametrize("block", [2, 256])
def test_near_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "und"]) if rng.random() < 0.3 else "".join(rng.choice("abcdef") for _ in range(4))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(120)] = word()
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, pairs = spotsigs.near_pairs(docs, 80)
    of = {r.doc_id: r["class"] for r in members.collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    s = [set(x) for x in sets(spark, texts)]
    want = {tuple(sorted((of[i], of[j]))) for i in range(len(s)) for j in range(i) if s[i] != s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])}
    assert got == want and want


def chains(text):
    """A text's signatures, word by word."""
    import re

    words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (text or "").lower()) if w]
    anchors = {w for ws in spotsigs.ANCHORS.values() for w in ws}
    out = set()
    for i, w in enumerate(words):
        rest = words[i + 1 :]
        if w in anchors and rest and rest[0] not in anchors:
            after = [x for x in rest[1:] if x not in anchors][:1]
            out |= {(w, rest[0], after[0])} if after else set()
        if w not in anchors and len(rest) > 1 and not {rest[0], rest[1]} & anchors:
            out.add((w, rest[0], rest[1]))
    return out or {tuple(words)}


def test_likeness_equals_sets_of_chains(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "und", "les", "cat", "mat", "sat", "hat", "dog", "Über", "x1", "run,", "(far)"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(120)]
    rows = list(enumerate([*texts, texts[0], None, "one two", "Two. One!", "cat mat sat dog run far", "the cat mat sat dog run far"]))
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    prints = {}
    for i, t in rows:
        nxt = dict(rows)[(i - 1) % len(rows)] or ""
        t = t or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[i].near_next == like(chains(t), chains(nxt)) and got[i].near_edited == like(chains(t), chains(edited))
        assert prints.setdefault(got[i].fingerprint, chains(t)) == chains(t)
        assert prints.setdefault(got[i].edited_fingerprint, chains(edited)) == chains(edited)
    assert len({frozenset(s) for s in prints.values()}) == len(prints)
    # one anchor before a list of words leaves what it had
    assert like(chains(rows[-2][1]), chains(rows[-1][1])) > 0.5


def test_rows_of_one_id_are_parted(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices(["the", "cat", "of", "mat", "sat"], k=6)) + str(rng.random())
    rows = [(rng.choice([None, 5, 5, i]), text()) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    led = spotsigs.with_next(docs, ["text"]).collect()
    # one cycle through all rows, ids descending with null ones last
    after = {(r.doc_id, r.text): r.next.text for r in led}
    ids = {t: i for i, t in rows}
    assert len(after) == 900 and len(set(after.values())) == 900
    falls = sum((ids[b] is None) < (ids[a] is None) or (ids[a] is not None and ids[b] is not None and ids[b] > ids[a]) for (_, a), b in after.items())
    assert falls <= 1


def test_near_classes_of_the_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = spotsigs.near_classes(docs).collect()
    texts = {r.doc_id: chains(r.text) for r in docs.collect()}
    classes = {r.doc_id: r["class"] for r in got}
    distinct = {classes[i]: s for i, s in texts.items()}
    links = {c: 0 for c in distinct}
    for a in distinct:
        for b in distinct:
            if a != b and 100 * len(distinct[a] & distinct[b]) >= 80 * len(distinct[a] | distinct[b]):
                links[a] += 1
    assert {r.doc_id: r.n_links for r in got} == {i: links[c] for i, c in classes.items()}
    assert len(got) == len(texts) and any(links.values())
    assert spotsigs.near_classes(docs.limit(0)).collect() == []


def test_sets_that_cannot_match_are_left_behind(spark, monkeypatch):
    kept = {}

    def stored(df, name="step", by=()):
        kept[name] = keep(df, name, by)
        return kept[name]

    keep = spotsigs.stored
    monkeypatch.setattr(spotsigs, "stored", stored)
    alone = [" ".join(f"w{i}x{j}" for j in range(30)) + " one two three" for i in range(20)]
    # each two of these share one phrase and nothing else
    met = [" ".join(f"the p{min(i, j)}q{max(i, j)} a{min(i, j)}b{max(i, j)} c{min(i, j)}d{max(i, j)}" for j in range(25) if j != i) for i in range(25)]
    docs = spark.createDataFrame(list(enumerate([*alone, *met, met[0] + " more"])), "doc_id long, text string")
    members, pairs = spotsigs.near_pairs(docs)
    assert [(r.a, r.b) for r in pairs.collect()] == [tuple(sorted(r["class"] for r in members.where("doc_id in (20, 45)").collect()))]
    assert kept["sets"].count() <= 26
    assert all("class" not in kept[k].columns for k in ("sets", "prefixes", "candidates"))
    # of 325 pairs, those with a shared signature so late that too little lies behind it are none
    seen = kept["prefixes"]
    both = seen.alias("a").join(seen.alias("b"), "sig").where("a.id < b.id").select("a.id", "b.id").distinct().count()
    assert kept["candidates"].count() < both
