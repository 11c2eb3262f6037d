import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from passbook.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, n_bytes string"


def brute(texts, w):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + w] for r in raw for i in range(len(r) - w + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - w + 1):
            if seen[r[i : i + w]] > 1:
                gone[1 + i : 1 + i + w] = True
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(b for b, g in zip(r, gone[1:]) if not g)).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 6)))
    text = lambda m: " ".join(word() for _ in range(m))
    base, passage = text(60), text(12)
    texts = [None, "", "x", "aaaa" * 80, base, base]
    for _ in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            words = base.split()
            words[rng.randrange(60)] = word()
            texts.append(" ".join(words))
        elif kind == 1:
            texts.append(text(rng.randint(0, 30)) + " " + passage + " " + text(rng.randint(0, 30)))
        elif kind == 2:
            texts.append(text(rng.randint(0, 80)))
        else:
            cut = rng.randrange(len(base))
            texts.append(text(5) + base[cut : cut + 40] + text(5) + base[cut : cut + 41])
    return texts


@pytest.mark.parametrize("p", [sd.Repeats(window=20, gram=6, shard_bytes=4000), sd.Repeats(window=20, gram=6, hot=3, shard_bytes=2000)])
def test_equals_brute_force(spark, p):
    texts = corpus(1, 150)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.cut_repeats(docs, p, digest=True).collect()}
    assert got == dict(enumerate(brute(texts, 20)))


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 64)
    p = sd.Repeats(window=20, gram=6)
    texts = corpus(2, 30)
    rows = []
    for t in texts:
        raw = [(t or "").encode()]
        for ids, offsets, parts in sd._chunks(raw, p):
            ends = np.cumsum([len(x) for x in parts])
            k, first, last, _, _ = sd.segments(np.frombuffer(b"".join(parts), np.uint8), ends, p)
            rows += [s - ([0, *ends][j]) + offsets[j] for j, a, b in zip(k, first, last) for s in range(a, b + 1)]
        assert sorted(rows) == list(range(max(0, len(raw[0]) - 19)))
        rows = []


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[2000:2400]
    raw = data.tobytes()
    sa = sd.suffix_array(data)
    assert sa.tolist() == sorted(range(3000), key=lambda i: raw[i:])
    lcp = sd.common_prefixes(data, sa, 200)
    for k in range(1, 3000):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, 200)


def test_nulls_repeats_and_empty_tables(spark):
    p = sd.Repeats(window=20, gram=6)
    t = "some words that are long enough to repeat é"
    docs = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (None, "short", "b"), (None, None, "c"), (2, "x" + t[:-1] + "ñ", "d")], SCHEMA)
    rows = sd.cut_repeats(docs, p).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in rows if r.text is not None) == [(0, "short", 0), (1, "", 44), (1, "", 44), (2, "xñ", 43)]
    assert sum(r.text is None for r in rows) == 1
    assert sd.cut_repeats(docs.limit(0), p).collect() == []
    assert sd.cut_repeats(docs.limit(0), p).columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans"]


def test_repeated_rows_take_linear_work(spark):
    """Each copy of a row gets each place once, however many copies there are."""
    import random

    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    for n in (30, 300):
        docs = spark.createDataFrame([(None if i % 2 else 7, text) for i in range(n)], "doc_id long, text string")
        key = docs.selectExpr("coalesce(doc_id, -1) as doc_id", "xxhash64(text) as tag", "text")
        held = sd._starts(key, sd.Repeats()).collect()
        assert len(held) == 2 and len({len(r.held) for r in held}) == 1 and len(held[0].held) < 120
        got = sd.cut_repeats(docs).collect()
        assert len(got) == n and all(r.n_removed == 5000 and r.text == "" for r in got)
