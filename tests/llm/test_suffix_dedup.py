import hashlib
import random
from collections import Counter

import pytest

from consensa.llm import suffix_dedup as s


def brute(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for k, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def got(df, length):
    out = []
    for r in s.repeated_spans(df, length).collect():
        spans = [(x.start, x.end) for x in r.spans or []]
        rest = hashlib.sha256(bytes(r.rest)).hexdigest() if r.spans else r.sha256
        out.append((r.doc_id, r.n_bytes, sum(e - b for b, e in spans), len(spans), rest))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [24, 40])
def test_against_brute_force(spark, length, monkeypatch):
    rng = random.Random(length)
    shared = ["".join(rng.choices("abcdé ", k=rng.randint(length - 6, 3 * length))) for _ in range(6)]
    rows = [(0, None), (1, ""), (None, "short"), (2, "a" * 150), (3, "ab" * 60), (4, "x" * (length - 1)), (5, "y" * length)]
    for i in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choices("abcdé ", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        rows.append((10 + i, "".join(parts)))
    rows += [rows[-1], rows[-2], (77, rows[-3][1])]
    df = spark.createDataFrame([(k, t, b"clash") for k, t in rows], "doc_id long, text string, rest binary")
    want = brute(rows, length)
    assert sum(w[2] > 0 for w in want) > 20
    assert got(df, length) == want


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choices(b"abc", k=3000))
    window = s.window_of(40)
    whole = s.runs(data, 40, window)
    spell = lambda r: {i: int(a) for f, e, a in zip(*r, strict=True) for i in range(f, e + 1)}
    monkeypatch.setattr(s, "PIECE", 256)
    assert spell(s.runs(data, 40, window)) == spell(whole)


def test_empty_table(spark):
    assert s.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
