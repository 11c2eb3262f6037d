"""Cross-tokenizer alignment against the two libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from passbook.llm import alignment
from passbook.llm.alignment import Aligner, ByteLevel, Pieces

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return Aligner(ByteLevel(open(A, "rb").read()), Pieces(open(B, "rb").read()))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """(n_a, n_b, n_groups, groups, n_links, n_best, count_sum) of each text, link by link."""
    t, sp = libraries
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in shown}
    free = 256
    for b in range(256):
        if b not in shown:
            chars[chr(free)] = b
            free += 1
    out, links = [], []
    for text in texts:
        spans = []
        if text:
            a = t.encode(" " + text, add_special_tokens=False)
            b = sp.encode(text)
            a_bytes = [bytes(chars[c] for c in x) for x in a.tokens]
            b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(sp.id_to_piece, b))]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                for ids, parts in ((a.ids, a_bytes), (b, b_bytes)):
                    at, own = 0, []
                    for i, x in zip(ids, parts):
                        own.append((i, at, at + len(x)))
                        at += len(x)
                    spans.append(own)
        if not spans:
            out.append((0, 0, 0, "", 0))
            links.append([])
            continue
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans))
            lo = hi
        own = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        links.append(own)
        out.append((len(spans[0]), len(spans[1]), len(groups), ";".join(groups), len(own)))
    count = Counter(x for own in links for x in own)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return [(*r, sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own)) for r, own in zip(out, links)], count, most


TEXTS = [
    "plain words, again and again", "", None, " ", "  ", "a  b   c", " lead", "trail ", "trail  ", "<s> </s> <|endoftext|> <unk> <0x41> <pad>", "tab\there\n\n new\r\nline",
    "naïve café ﬁ ① 가나다 日本語テキスト", "a▁b ▁ c", "x" * 300, "emoji 👩‍👩‍👧 🇩🇪", "zero\x00byte \x01 \x7f", "1234567 1,234.50 3rd", "don't we'll I'M", " nbsp em​zw", "é combining", "plain words, again and again",
]


def frame(spark, texts):
    rows = [(i if i % 7 else None, t, "x", 3, {"a": 1}, [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, groups string, block int, own map<string,int>, keys array<int>")


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "token", "Tokenizer", "überall", "größe", "naïve", "x1y2", "--", "don't", "日本", "\n", "\t", " ", "https://example.com/a?b=1", "12345"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(n)]


def test_equals_brute_force(spark, libraries, monkeypatch):
    texts = [*TEXTS, *corpus(1, 60), *["the the the token"] * 40]
    want, count, most = brute(texts, libraries)
    got = alignment.aligned(frame(spark, texts), A, B)
    assert got.columns == ["doc_id", "block", "own", "keys", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    rows = sorted(repr((r.doc_id, *r[4:])) for r in got.collect())
    assert rows == sorted(repr((i if i % 7 else None, *w)) for i, w in enumerate(want))
    digests = alignment.aligned(frame(spark, texts), A, B, digest=True).select("groups_sha256").collect()
    assert sorted(r[0] for r in digests) == sorted(w[3] and hashlib.sha256(w[3].encode()).hexdigest() for w in want)
    pairs = alignment.pair_counts(frame(spark, texts), A, B).collect()
    assert {((r.a, r.b), r["count"], r.best) for r in pairs} == {(x, n, n == most[x[1]]) for x, n in count.items()}
    assert len(pairs) == len(count)


def test_small_blocks_and_many_salts(spark, libraries, monkeypatch):
    """Blocks of few links and groups of few bytes, so that runs are merged in several turns, give the same."""
    monkeypatch.setattr(alignment, "MERGE_BYTES", 400)
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 50)
    texts = [*corpus(2, 80), *["the the the token"] * 80]
    want, _, _ = brute(texts, libraries)
    got = alignment.aligned(frame(spark, texts).repartition(8), A, B)
    assert sorted(repr((r.doc_id, *r[4:])) for r in got.collect()) == sorted(repr((i if i % 7 else None, *w)) for i, w in enumerate(want))


def test_ids_equal_the_libraries(aligner, libraries):
    """Pre-tokens and words apart give what whole texts give, over all code points and long texts."""
    t, sp = libraries
    assert aligner.b.apart and aligner.a.encoder.apart
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    rng = random.Random(5)
    texts = ["".join(points[lo : lo + 4000]) for lo in range(0, len(points), 16_000)]
    texts += [" ".join(rng.sample(points, 500)) for _ in range(40)]
    texts += ["".join(rng.choices(["a", " ", "▁", "\n", "Z", "é", "1"], k=200)) for _ in range(200)]
    texts += [" ".join(corpus(3, 3000)), "word" * 40_000, ("ab1 " * 70_000)]
    spaced = [" " + x for x in texts]
    for text, a, b in zip(texts, aligner.a.encode(spaced), aligner.b.encode(spaced)):
        assert a.tolist() == t.encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == sp.encode(text)


def test_merge_of_runs():
    rng = np.random.default_rng(1)
    for n, slice_ in ((1, 3), (5, 2), (40, 7), (3, 1000)):
        want, runs = Counter(), []
        for _ in range(n):
            keys = np.unique(rng.integers(0, 300, rng.integers(1, 200)))
            counts = rng.integers(1, 9, len(keys))
            want.update(dict(zip(keys.tolist(), counts.tolist())))
            runs.append(iter([(keys[i : i + slice_], counts[i : i + slice_]) for i in range(0, len(keys), slice_)]))
        got = [(int(k), int(c)) for keys, counts in alignment.merge_runs(runs) for k, c in zip(keys, counts)]
        assert got == sorted(want.items())
    assert list(alignment.merge_runs([])) == []


def test_packed_runs_come_back():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 60, 10_000))
    counts = np.arange(1, len(keys) + 1)
    found = list(alignment.open_run(*alignment.pack_run(keys, counts)))
    assert np.array_equal(np.concatenate([k for k, _ in found]), keys) and np.array_equal(np.concatenate([c for _, c in found]), counts)


def test_no_rows_and_no_tokens(spark):
    assert alignment.aligned(frame(spark, []), A, B).count() == 0
    got = alignment.aligned(frame(spark, [None, "", "a▁"]), A, B, digest=True).collect()
    assert [(r.n_a, r.groups_sha256, r.count_sum) for r in got] == [(0, "", 0)] * 3
