import random
import zlib

import numpy as np

from passbook.llm import toxicity


def test_learns_words_and_leaves_clean_rows_alone(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    rows, labels = [], []
    for i in range(1200):
        w = [word() for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["Vilest,", "rotten", "wretch."]))
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(5000, None, "x"), (5001, "", "x"), (None, "rotten vilest", "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(0, labels[0][1]), (3, None), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.train(docs, marks.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs, weights).select("*", toxicity.held_out().alias("held_out")).collect()}
    truth = dict(labels)
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(out)) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in out]) > 0.95
    assert got[None].predicted == 1 and got[5000].score == got[5001].score < 0.5
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())
    assert weights.count() < 10_000  # of some hundred thousand features


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.train(docs, none)
    assert [r.predicted for r in toxicity.score(docs, weights).collect()] == [0]
    assert toxicity.score(docs.limit(0), weights).collect() == []


def test_fit_equals_ftrl_coordinate_by_coordinate():
    """Weights after FTRL-proximal steps written out for single coordinates."""
    import numpy as np

    from passbook.llm.toxicity import Ftrl, fit

    p = Ftrl(bits=6, epochs=3)
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 1 << p.bits, rng.integers(0, 12))).astype(np.uint32) for _ in range(60)]
    rows.append(np.arange(1 << p.bits, dtype=np.uint32))
    y = rng.integers(0, 2, len(rows)).astype(float)
    ends = np.cumsum([0, *map(len, rows)])
    got = fit(np.concatenate(rows), ends, y, p)

    z, n = [0.0] * ((1 << p.bits) + 1), [0.0] * ((1 << p.bits) + 1)
    bias = 1 << p.bits

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == bias else (p.l1, p.l2)
        if abs(z[i]) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((p.beta + n[i] ** 0.5) / p.alpha + l2)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)).tolist():
            own = rows[k].tolist()
            w = {i: weight(i) for i in [*own, bias]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[k]
            g *= p.toxic_weight if y[k] else 1
            shared = g / max(1.0, (len(own) / 200) ** 0.5)
            for i in [*own, bias]:
                step = g if i == bias else shared
                sigma = ((n[i] + step * step) ** 0.5 - n[i] ** 0.5) / p.alpha
                z[i] += step - sigma * w[i]
                n[i] += step * step
    assert np.allclose(got, [weight(i) for i in range(len(z))], rtol=1e-9, atol=1e-12)
    assert (got == 0).any() and (got != 0).any()
