import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from passbook.llm import pretokens, tokenfile  # noqa: E402
from tests.llm.test_bpe import every_code_point, texts  # noqa: E402


@pytest.mark.parametrize("name,shard", [("byte_bpe_50k.json", 300), ("byte_bpe_50k.json", 1 << 22), ("word_bpe_49k.json", 1 << 22)])
def test_files_equal_the_library(spark, monkeypatch, name, shard):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", shard)
    path = P.path(name)
    rows = [(3 * i - 50, t, "clash") for i, t in enumerate(texts())] + [(None, "no id", "x"), (7, None, "x"), (1, "twice", "x"), (1, "twice", "x"), (1, "thrice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    files = tokenfile.write(docs, path)
    library = tokenizers.Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t, _ in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in tokenfile.summary(spark, files).collect()), key=lambda r: r[1])
    assert got == want
    held = {r.doc_id: r.ids for r in tokenfile.fetch(spark, files, [-50, 7, 9999]).collect()}
    assert set(held) == {-50, 7} and held[7] == [0]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files = tokenfile.write(docs, P.path("byte_bpe_50k.json"))
    assert tokenfile.summary(spark, files).collect() == []
    assert tokenfile.fetch(spark, files, [1]).collect() == [] and tokenfile.fetch(spark, files, []).collect() == []


def test_splitting_equals_the_library(monkeypatch):
    content = open(P.path("byte_bpe_50k.json"), "rb").read()
    encoder, rng = tokenfile.Encoder(content), random.Random(5)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", " ", "\n", "\t", "\xa0", "a", "Z", "é", "1", "٣", "!", "''", "'s", "  ", "日", "🎉", "\r\n"]
    all_ = texts() + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in all_]
    for chunk, most in ((1 << 17, 1_000_000), (50, 1_000_000), (1 << 12, 10)):
        monkeypatch.setattr(pretokens, "CHUNK", chunk)
        monkeypatch.setattr(pretokens, "REMEMBERED", most)
        assert [x.tolist() for x in tokenfile.Encoder(content).encode(all_)] == want


def test_every_code_point_equals_the_library():
    encoder, all_ = tokenfile.Encoder(open(P.path("byte_bpe_50k.json"), "rb").read()), every_code_point()
    want = [x.ids for x in encoder.library.encode_batch(all_, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(all_)] == want
