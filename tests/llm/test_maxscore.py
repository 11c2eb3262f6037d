import math

import numpy as np
import pytest

from passbook.llm import maxscore


@pytest.mark.parametrize("values,queries,run,first,scale", [(1 << 19, 128, 2048, 256, 1), (1500, 5, 7, 6, 1), (4000, 2, 20, 3, 1e5)])
def test_equals_brute_force(spark, monkeypatch, values, queries, run, first, scale):
    for name, value in (("IMPACTS", values), ("QUERIES", queries), ("RUN", run), ("FIRST", first)):
        monkeypatch.setattr(maxscore, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40)) * rng.choice([0.1, 3], 40) * scale
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300, None), (350, [float("nan")] * 40), (400, [None] * 40), (450, [1.0] * 39 + [float("inf")]), (None, [1.0] * 40), (301, [1.0] * 3), (302, []), (0, x[0].tolist())]
    v = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = {}
    for r in maxscore.top_k(v, v.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    e = {i: [math.floor(256 * c) for c in r] + [0] * (40 - len(r)) for i, r in rows if i is not None and i in (*range(300), 301, 302)}
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(e[q], e[i])), i) for i in e if i != q)[:5]
        assert got.pop(q) == {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
    assert not got


def test_few_and_none(spark):
    v = maxscore.quantised(spark.createDataFrame([(0, [1.0]), (1, [-0.001])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in maxscore.top_k(v, v.where("vec_id = 0")).collect()] == [(0, 1, 1, -256)]
    assert maxscore.top_k(v.limit(0), v.limit(0)).collect() == []


def test_terms_that_cannot_decide_are_probed_only_by_candidates_that_can():
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (3000, 30))
    x[:, :4] *= 1000
    shard = maxscore.Shard(np.arange(3000), x)
    who, ids, score = shard.search(x[:40], np.arange(40), 5)
    full = x[:40] @ x.T
    full[np.arange(40), np.arange(40)] = -(10**9)
    want = [sorted(range(3000), key=lambda i: (-full[q, i], i))[:5] for q in range(40)]
    assert who.tolist() == [q for q in range(40) for _ in range(5)] and ids.reshape(40, 5).tolist() == want


def test_impacts_that_could_wrap_raise(spark):
    import pytest

    rows = maxscore.quantised(spark.createDataFrame([(0, [1e30, 1.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="62 bits"):
        maxscore.top_k(rows, rows)
