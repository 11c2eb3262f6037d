import base64
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from passbook.llm import bpe, pretokens  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def texts():
    rng = random.Random(3)
    some = ["", " ", "  a  b\n\n c", "it's we'll 123 ４５ ñandú x 日本語テキスト 🎉🎉 \r\n\t end  ", "a" * 3000, "\x00\x01é", "<|endoftext|>", "ab" * 700]
    return some + ["".join(chr(rng.choice([32, 32, 10, 39, *range(97, 123), 233, 0x4E00 + rng.randrange(500), rng.randrange(0x20, 0xD000)])) for _ in range(rng.randint(0, 200))) for _ in range(200)]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_and_decodes(spark):
    own, all_ = library(), texts()
    rows = [(i, t, "clash") for i, t in enumerate(all_)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode_texts(docs, PATH, P.PATTERN).collect()}
    for i, t in enumerate(all_):
        assert got[i].ids == own.encode_ordinary(t)
        assert bytes(got[i].decoded) == t.encode()
    assert got[None].ids == [] and bytes(got[None].decoded) == b""
    digests = {r.doc_id: r for r in bpe.encode_texts(docs, PATH, P.PATTERN, digest=True, keep=["doc_id"]).collect()}
    assert digests[3].ids_sha256 == hashlib.sha256(",".join(map(str, got[3].ids)).encode()).hexdigest()
    assert digests[3].decoded_sha256 == hashlib.sha256(all_[3].encode()).hexdigest() and digests[3].n_tokens == len(got[3].ids)
    assert bpe.encode_texts(docs.limit(0), PATH, P.PATTERN).collect() == []


def every_code_point():
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    return ["".join(f"a{chr(c)}1 " for c in points[lo : lo + 4096]) for lo in range(0, len(points), 4096)]


def test_every_code_point_equals_the_library():
    codec, own = bpe.Codec(open(PATH, "rb").read(), P.PATTERN), library()
    all_ = every_code_point()
    for t, ids in zip(all_, codec.encode_all(all_)):
        assert ids.tolist() == own.encode_ordinary(t)


def test_forgetting_and_chunks_change_nothing(monkeypatch):
    own, all_ = library(), texts() + [" ".join(texts()), "é1" * 4000, "1a" * 3000 + " " * 50]
    for names, value in ((("REMEMBERED",), 3), (("REMEMBERED_POINTS",), 40), (("CHUNK",), 50)):
        for name in names:
            monkeypatch.setattr(pretokens, name, value)
        codec = bpe.Codec(open(PATH, "rb").read(), P.PATTERN)
        assert [x.tolist() for x in codec.encode_all(all_)] == [own.encode_ordinary(t) for t in all_]


def test_hashes_that_collide_change_nothing(monkeypatch):
    monkeypatch.setattr(pretokens, "mix", lambda h: h & type(h[0])(63))
    codec, own = bpe.Codec(open(PATH, "rb").read(), P.PATTERN), library()
    assert all(codec.encode(t) == own.encode_ordinary(t) for t in texts())


def test_other_patterns():
    pattern = r"\S+|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(open(PATH, "rb").read(), pattern)
    assert all(codec.encode(t) == own.encode_ordinary(t) for t in texts()[:8])


def test_perfect_hash_is_minimal():
    import numpy as np
    import xxhash

    hashes = np.array([xxhash.xxh3_64_intdigest(str(i)) for i in range(5000)], np.uint64)
    table = bpe.PerfectHash(hashes)
    assert sorted(table.slots(hashes).tolist()) == list(range(5000))
    assert (bpe.PerfectHash.from_bytes(table.to_bytes()).slots(hashes) == table.slots(hashes)).all()
    assert bpe.PerfectHash(hashes[:0]).slots(hashes[:2]).tolist() == [-1, -1]
