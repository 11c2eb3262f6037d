import random

import numpy as np
import pytest

from passbook.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, weight string"


def corpus(n=1500):
    rng = random.Random(6)
    out = []
    for i in range(n):
        source = "big" if rng.random() < 0.4 else f"s{rng.randrange(4)}"
        theme = rng.choice(["galaxies", "harvests", "sonatas"])
        out.append((i, " ".join([theme] * 3 + ["word"] * rng.randint(1, 60)), rng.choice(["en", "en", "de", None]), source, "clash"))
    return out


@pytest.mark.parametrize("most", [50_000, 0])
def test_marginals_meet_targets_and_kept_tokens_the_budget(spark, most):
    p = mixing.Mix(max_cells=most, topics=5, tolerance=1e-4, rounds=30 if most else 6)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(4)
    rows = mixing.measured(docs, p)
    cells = rows.groupBy(*mixing.DIMENSIONS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "weight")
    targets = mixing.own_targets(cells, p)
    fitted = [r.asDict() for r in mixing.rake(cells, targets, p).collect()]
    total = sum(r["weight"] for r in fitted)
    for d in mixing.DIMENSIONS:
        for value, share in ((r.value, r.share) for r in targets[d].collect()):
            assert sum(r["fitted"] for r in fitted if r[d] == value) == pytest.approx(share * total, rel=0.01)
    got = mixing.mixed(docs, p).collect()
    assert len(got) == 1500 and all(0 <= r.probability <= 1 for r in got)
    n = np.array([r.n_tokens for r in got])
    assert (n * [r.probability for r in got]).sum() == pytest.approx(0.9 * n.sum(), rel=0.01)
    assert n[[r.kept for r in got]].sum() == pytest.approx(0.9 * n.sum(), rel=0.05)
    # kept tokens times their repeats have the targets' shares
    kept = [r for r in got if r.kept]
    every = sum(r.n_tokens * r.repeats for r in kept)
    for d in mixing.DIMENSIONS:
        for value, share in ((r.value, r.share) for r in targets[d].collect()):
            assert sum(r.n_tokens * r.repeats for r in kept if r[d] == value) == pytest.approx(share * every, rel=0.12)
    assert all(r.repeats == pytest.approx(1) or r.probability == 1 for r in got)
    again = {r.doc_id: r.kept for r in mixing.mixed(docs.repartition(7), p).collect()}
    assert again == {r.doc_id: r.kept for r in got}


def test_both_ways_of_raking_agree(spark):
    docs = spark.createDataFrame(corpus(300), SCHEMA)
    rows = mixing.measured(docs, mixing.Mix(topics=3))
    cells = rows.groupBy(*mixing.DIMENSIONS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "weight").cache()
    found = []
    for most in (50_000, 0):
        p = mixing.Mix(topics=3, max_cells=most, rounds=4, tolerance=1e-3)
        found.append({tuple(r[:3]): r.fitted for r in mixing.rake(cells, mixing.own_targets(cells, p), p).collect()})
    assert found[0].keys() == found[1].keys() and all(found[1][k] == pytest.approx(v, rel=1e-9) for k, v in found[0].items())


def test_topic_and_odd_rows(spark):
    rows = [(1, "galaxies galaxies harvests of", "en", "a", "x"), (2, "harvests, galaxies! GALAXIES", "en", "a", "x"), (3, None, None, None, "x"), (4, "", "en", "a", "x"), (None, "a b c", None, None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    assert got[1].topic == got[2].topic >= 0 and got[3].topic == got[4].topic == got[None].topic == -1
    assert got[3].kept and got[4].kept and got[3].n_tokens == 0 and got[None].n_tokens == 3
    assert mixing.mixed(docs.limit(0)).collect() == []
