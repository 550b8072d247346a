import random
import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from consensa.llm import near_dedup as n

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(t):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def fixture(seed, groups, members, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(60, 140))
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) + 10, " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a b"), (3, "A  B"), (9, "a"), (None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"),
            (None, "q r s t u v w"), (2, "long " * 3000)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, kept string")
    out = n.link(df)
    assert rows_of(out) == brute(rows)
    stays = out.where("stays").groupBy("component_id", F.col("n_shingles") == 0).count().collect()
    assert all(r["count"] == 1 for r in stays) and out.where("n_shingles = 0 and stays").count() == 3
    assert out.where("kept").count() >= out.where("stays").count() - 1
    assert n.link(df.limit(0)).collect() == []


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(n, "SMALL", 6)  # so that nodes branch
    rows = fixture(4, 3, 14, 6) + [(1, "one of its own kind and no other like it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(n.link(df)) == brute(rows)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    df = spark.createDataFrame([(a.to_bytes(2), b.to_bytes(2)) for a, b in pairs], "a binary, b binary")
    got = {int.from_bytes(r.node): int.from_bytes(r.comp) for r in n.components(df).collect()}
    comp = {x: x for p in pairs for x in p}
    while True:
        new = dict(comp)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == comp:
            break
        comp = new
    assert got == {x: c for x, c in comp.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_planted_pairs_meet_below_large_nodes(spark):
    rng = random.Random(7)
    some = lambda k: [rng.getrandbits(63) for _ in range(k)]
    signatures = []
    for k in range(150):
        both = some(170)
        for own in (some(15), some(15)):  # 170 / 200 is the limit
            s = n.signature(np.array(sorted(both + own), np.uint64)).tobytes()
            signatures.append((bytes([k]), s))
    df = spark.createDataFrame(signatures, "cls binary, sig binary").withColumn("member", F.row_number().over(
        Window.partitionBy("cls").orderBy("sig")).cast("string").cast("binary"))
    at = F.explode(F.array([F.lit(i) for i in range(n.TREES)])).alias("at")
    large = df.select(F.concat("cls", "member").alias("cls"), "sig", at).select(
        "cls", "sig", F.lit(18).alias("levels"), F.xxhash64("at", n._token(F.col("sig"), F.col("at"))).alias("path"))
    down = n._branched(large, n.PERCENT, n.TREES, 0).select("path", F.substring("cls", 1, 1).alias("pair"), "cls").distinct()
    met = down.groupBy("path", "pair").count().where("count = 2").select("pair").distinct().count()
    assert met >= 149  # with a chance of a thousandth, 150 pairs lose none or one


def test_repeats_follow_the_levels():
    few = n.repeats(85, n.TREES, 0)
    assert few[0] == 1 and few == sorted(few) and few[17] > 3
    assert all(x <= y for x, y in zip(few, n.repeats(85, n.TREES, 1), strict=True))


def test_few_texts_are_asked_for_by_name(spark, monkeypatch):
    """Which texts are wanted is known before their shingles are: few of them are sent to the texts, which aren't shuffled."""
    names, written = [], n.written
    monkeypatch.setattr(n, "written", lambda df, name: names.append((name, df._jdf.queryExecution().toString())) or written(df, name))
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words + " more"), (3, " ".join(f"v{i}" for i in range(60)))]
    out = n.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(out) == brute(rows)
    order = [name for name, _ in names]
    assert order.index("wanted") == order.index("shingles") - 1
    plan = next(plan for name, plan in names if name == "shingles")
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin [k1" not in plan


def test_link_leaves_little_written(spark):
    """Signatures, shingles and nodes go as soon as nothing reads them; of a call only the rows' components stay."""
    import os
    from consensa.session import ensure_checkpoint_dir
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words + " more"), (3, " ".join(f"v{i}" for i in range(60))), (4, None)]
    out = n.link(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(top)) - before}
    assert "linked" in left and not left & {"sets", "classes", "rows", "nodes", "shingles"}
    assert rows_of(out) == brute(rows)
