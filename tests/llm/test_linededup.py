"""Line dedup against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from passbook.llm import linededup
from passbook.llm.linededup import Lines

SCHEMA = "doc_id long, text string, n_lines string, keep int, doc string, `tag_` int, body map<string,int>"


def brute(rows, p):
    """(kept text, lines, dropped) of each row; rows that agree in id and text are one document."""
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holds = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= p.points:
                holds[key(line)].add((doc, text))
    repeated = {k for k, d in holds.items() if len(d) >= p.documents}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in repeated]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 7, "y", 1, {"a": 1}) for d, t in rows], SCHEMA)


def corpus(seed, n=120):
    rng = random.Random(seed)
    lines = ["", " ", "Common", "common \t", "Äb", "äb", "x", "\x85y", "y", *(f"line {i}" for i in range(30))]
    rows = [(i, "\n".join(["hot line", *rng.choices(lines, k=rng.randint(0, 8))])) for i in range(n)]
    return [*rows, (7, "again\nline 1"), (None, "line 1\nHOT line"), (None, "line 1\nHOT line"), (None, None), (5, ""), rows[3]]


@pytest.mark.parametrize("p", [Lines(10, 1, False), Lines(3, 0, False), Lines(2, 6, False), Lines(500, 1, False)])
def test_all_lines_of_repeated_keys_go(spark, p):
    rows = corpus(p.documents)
    got = linededup.cut_lines(frame(spark, rows), p)
    assert got.columns == ["doc_id", "text", "keep", "doc", "tag_", "body", "n_lines", "n_dropped"]
    want = [(d, t if t is None and not gone else kept, n, gone) for (d, t), (kept, n, gone) in zip(rows, brute(rows, p))]
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()))) == sorted(map(repr, want))
    digests = linededup.cut_lines(frame(spark, rows), p, digest=True)
    assert sorted(map(repr, map(tuple, digests.collect()))) == sorted(repr((d, n, gone, hashlib.sha256(k.encode()).hexdigest())) for (d, _), (k, n, gone) in zip(rows, brute(rows, p)))


@pytest.mark.parametrize("documents", [1, 2, 4])
def test_the_first_line_of_a_key_stays_once(spark, documents):
    rows = corpus(9, 60)
    got = linededup.cut_lines(frame(spark, rows), Lines(documents, 1, True)).collect()
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holds, left = defaultdict(set), defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            holds[key(x)].add((d, t))
    kept_lines = defaultdict(int)
    seen = set()
    for r in got:
        for x in (r.text or "").split("\n"):
            left[key(x)].add(r.doc_id)
            kept_lines[key(x)] += (r.doc_id, r.text) not in seen
        seen.add((r.doc_id, r.text))
    for k, d in holds.items():
        if k and len(d) >= documents:
            assert kept_lines[k] == 1
            # the least id holds it; a null id comes first
            assert next(iter(left[k])) == min((x for x, _ in d), key=lambda i: -(2**63) if i is None else i)
        elif k:
            assert left[k] == {x for x, _ in d}


def test_ranges_that_one_key_fills_decide_together(spark):
    """Records of few keys swept in pieces of any size give what one piece gives."""
    p = Lines(3, 1, True)
    records = [(k, k, d, 0, 2, (1).to_bytes(4, "little") * (1 + (d == 1))) for k, n in enumerate([1, 2, 3, 40, 2, 5]) for d in range(n)]

    def swept(cuts):
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, len(records)]):
            s = linededup._Sweep(p)
            for r in records[lo:hi]:
                s.add(r)
            s.close(True)
            out += s.out
        docs, head = defaultdict(int), {}
        for kind, hi_, lo_, d, t, n, _ in out:
            if kind == 3:
                docs[hi_, lo_] += n
                head[hi_, lo_] = min(head.get((hi_, lo_), (d, t)), (d, t))
        gone = [(h, d, at) for kind, h, _, d, _, _, at in out if kind == 0]
        for kind, h, g, d, t, _, at in out:
            if kind in (1, 2) and docs[h, g] >= p.documents:
                gone.append((h, d, at[4:] if kind == 1 and head[h, g] == (d, t) else at))
        return sorted(x for x in gone if x[2])

    want = [(k, d, (1).to_bytes(4, "little") * (1 + (d == 1))) for k, n in enumerate([1, 2, 3, 40, 2, 5]) for d in range(1, n) if n >= 3]
    for cuts in ([], [1], [5], [10, 11, 30], list(range(1, len(records)))):
        assert swept(cuts) == sorted(want), cuts


def test_bitmaps_without_texts(spark):
    rows = [(1, "a\nb\nb"), (2, "b\nc"), (3, "c\nd"), (4, None)]
    got = {r.doc_id: r for r in linededup.keep_bitmaps(frame(spark, rows), Lines(2, 1, False)).collect()}
    assert [(got[i].n_lines, got[i].n_dropped) for i in (1, 2, 3, 4)] == [(3, 2), (2, 2), (2, 1), (1, 0)]
    assert got[4].keep is None
    assert linededup.kept_lines(b"a\nb\nb", got[1].keep) == (b"a", 3)
    assert linededup.kept_lines(b"c\nd", got[3].keep) == (b"d", 2)


def test_no_rows_and_a_very_long_text(spark):
    assert linededup.cut_lines(frame(spark, []), Lines()).count() == 0
    long = "\n".join(f"row {i % 5000}" for i in range(60_000))
    got = linededup.cut_lines(frame(spark, [(1, long), (2, "row 7\n" + "z" * 2_000_000)]), Lines(2, 1, False)).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {1: 12, 2: 1}
    with pytest.raises(ValueError):
        Lines(0)
