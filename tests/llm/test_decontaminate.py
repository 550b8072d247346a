import random
import re
from collections import Counter

from consensa.llm import decontaminate as d

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text, items):
    w, out = words(text), set()
    for i, t in items:
        v = words(t)
        k = min(5, len(v))
        grams = lambda x: Counter(tuple(x[j:j + k]) for j in range(len(x) - k + 1))
        for s in range(len(w) - len(v) + 1) if v else ():
            a, b = grams(w[s:s + len(v)]), grams(v)
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                out.add((i, s))
    return out


def fixture():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 60)))) for i in range(25)] + [(90, "a b"), (91, ""), (92, None), (93, "a b")]
    docs = [None, "", "a", "x A  b y", "w1 " * 300]
    for i in range(40):
        w = rng.choices(vocabulary, k=rng.randint(0, 300))
        own = items[rng.randrange(25)][1].upper().split()
        if i % 2:
            for _ in range(rng.choice([0, 0, 0, 1])):
                own[rng.randrange(len(own))] = "other"
            w[len(w) // 2:len(w) // 2] = own
        docs.append(" \n".join(w))
    return items, docs + [docs[-1]]


def test_windows_against_brute_force():
    import numpy as np
    items, docs = fixture()
    bench = d.Benchmark([(i, t or "") for i, t in items])
    found = 0
    for t in docs:
        data = np.frombuffer((t or "").encode(), np.uint8)
        got = {(m[1], m[2]) for m in bench.matches(d.Words(data, np.array([0, len(data)])))}
        assert got == brute(t, items)
        found += bool(got)
    assert found >= 12


def test_marks_in_one_or_many_slices(spark, monkeypatch):
    items, docs = fixture()
    left = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, matches int")
    right = spark.createDataFrame(items, "item_id long, text string")
    run = lambda: {r.doc_id: {(m["item"]) for m in r.matches} for r in d.mark(left, right).collect()}
    once = run()
    assert once == {i: {m[0] for m in brute(t, items)} for i, t in enumerate(docs)}
    monkeypatch.setattr(d, "SLICE_ITEMS", 10)
    assert run() == once
    assert all(not r.matches for r in d.mark(left, right.limit(0)).collect())
    assert d.mark(left.limit(0), right).collect() == []


def test_item_cut_short_is_a_whole_document():
    import numpy as np
    rng = random.Random(5)
    own = [f"w{i}" for i in range(60)]
    bench = d.Benchmark([(7, " ".join(own)), (8, "a b")])
    cuts = {"last": own[:-1], "inner": own[:30] + own[31:], "tenth": own[:54], "ends": own[3:-3], "most": own[:30], "none": rng.sample(own, 59)}
    for name, w in cuts.items():
        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        got = list(bench.matches(d.Words(data, np.array([0, len(data)]))))
        grams = lambda x: Counter(tuple(x[j:j + 5]) for j in range(len(x) - 4))
        a, b = grams(w), grams(own)
        similarity = sum((a & b).values()) / sum((a | b).values())
        assert [m[1:] for m in got] == ([(7, 0, len(w), similarity)] if similarity >= 0.8 else []), name
        assert bool(got) == (name not in ("most", "none"))


def test_multi_index_finds_all_within_the_radius():
    import numpy as np
    rng = np.random.default_rng(3)
    for n in (1, 300, 30_000):  # few values in a block's table, and more than a neighbourhood has
        items = d.Items(20)
        items.rows = list(rng.integers(0, 1 << 16, (n, d.BLOCKS), dtype=np.uint16))
        items.index()
        assert (len(items.tables[0].values) > len(d.NEIGHBOURS)) == (n == 30_000)
        whole = np.unpackbits(items.prints.view(np.uint8), axis=1)
        windows = []
        for flips in (0, 8, 20, 38, 40, 41, 64):
            bits = whole[rng.integers(n)].copy()
            bits[rng.choice(d.BITS, flips, replace=False)] ^= 1
            windows.append(np.packbits(bits).view(np.uint16))
        prints = np.stack(windows + windows[:1])
        got = set(items.near(prints))
        for w, print_ in enumerate(prints):
            apart = (whole != np.unpackbits(print_.view(np.uint8))).sum(1)
            within = set(np.flatnonzero(apart <= d.RADIUS).tolist())
            assert {i for k, i in got if k == w} == within
            assert within <= set(np.flatnonzero(items.looked_up(print_[None])[0]).tolist())
        if n == 300:  # and whole distances are taken for a part of the items only
            assert items.looked_up(rng.integers(0, 1 << 16, (20, d.BLOCKS), dtype=np.uint16)).mean() < 0.8
