"""Vector codes against Lloyd's rounds in plain Python."""

import hashlib
import random
from math import floor, inf, nan

import numpy as np
import pytest

from passbook.llm import vectorcodes
from passbook.llm.vectorcodes import Codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x map<string,int>, part int, `group` int"


def brute(rows, p):
    kept = [(v, lab, [floor(p.scale * x) for x in e]) for v, e, lab in rows if e is not None and all(x is not None and abs(x) < inf for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // p.parts
    cut = lambda x: [x[i * width : (i + 1) * width] for i in range(p.parts)]
    books = [[cut(x)[i] for _, _, x in kept[: p.entries]] for i in range(p.parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda i, a: min(range(len(books[i])), key=lambda e: (far(a, books[i][e]), e))
    for _ in range(p.rounds):
        for i in range(p.parts):
            held = {}
            for _, _, x in kept:
                held.setdefault(near(i, cut(x)[i]), []).append(cut(x)[i])
            for e, own in held.items():
                books[i][e] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for v, lab, x in kept:
        at = [near(i, a) for i, a in enumerate(cut(x))]
        out.append((v, "".join(f"{a:02x}" for a in at), sum(far(a, books[i][at[i]]) for i, a in enumerate(cut(x))), lab))
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return [(v, c, e, sums[lab], digest) for v, c, e, lab in out]


def frame(spark, rows):
    return spark.createDataFrame([(v, e, lab, "c", {"a": 1}, 3, 4) for v, e, lab in rows], SCHEMA)


def vectors(seed, n, width=8, spread=1.0):
    rng = random.Random(seed)
    return [(i * 3 % 1000, [rng.gauss(0, spread) for _ in range(width)], rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("p", [Codes(entries=7), Codes(parts=2, entries=256), Codes(parts=8, entries=3, rounds=6), Codes(rounds=0, entries=5), Codes(parts=1, entries=1)])
def test_equals_brute_force(spark, p):
    hot = [0.25] * 8
    rows = vectors(p.entries, 150)
    rows += [(None, hot, 1), (4, None, 1), (5, [1.0, None] * 4, 1), (6, [nan] * 8, 2), (7, [inf] * 8, 2), rows[3], (rows[3][0], hot, None)]
    rows += [(2000 + i, hot, 9) for i in range(90)]
    got = vectorcodes.compressed(frame(spark, rows), p)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows, p)))


def test_large_components_stay_exact(spark):
    rows = vectors(2, 60, width=4, spread=20_000.0)
    p = Codes(parts=2, entries=5)
    got = vectorcodes.compressed(frame(spark, rows), p).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, p)))
    with pytest.raises(ValueError, match="too large"):
        vectorcodes.compressed(frame(spark, [(1, [1e30] * 4, 0)]))


def test_nearest_takes_the_lower_of_equals():
    at, far = vectorcodes.nearest(np.array([[1, 1], [5, 5]]), np.array([[0, 1], [2, 1], [5, 5], [5, 5]]))
    assert at.tolist() == [0, 2] and far.tolist() == [1, 0]


def test_no_rows_no_label_and_odd_lengths(spark):
    assert vectorcodes.compressed(frame(spark, [])).collect() == []
    assert vectorcodes.compressed(frame(spark, [(1, None, 2)])).collect() == []
    plain = spark.createDataFrame([(1, [1.0] * 4), (2, [2.0] * 4)], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.code, r.label_error) for r in vectorcodes.compressed(plain).collect()} == {(1, "00000000", 0), (2, "01010101", 0)}
    none = spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")
    assert [(r.code, r.error) for r in vectorcodes.compressed(none).collect()] == [("00000000", 0)]
    for odd in ([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [1.0] * 5, 0)]):
        with pytest.raises(ValueError):
            vectorcodes.compressed(frame(spark, odd))
