import random

from pyspark.sql import functions as F

from consensa.llm import line_dedup as d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def variants(seed, count, longest):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        a = "".join(rng.choice("abé\U0001F600") for _ in range(rng.randint(0, longest)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i, k = rng.randint(0, len(b)), rng.random()
            if k < 0.33:
                b.insert(i, rng.choice("abé"))
            elif b and k < 0.66:
                b.pop(min(i, len(b) - 1))
            elif b:
                b[min(i, len(b) - 1)] = rng.choice("abé")
        out.append((a, "".join(b)))
    return out


def test_banded_automaton(spark):
    pairs = variants(5, 800, 14)
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2):
        rows = df.withColumn("w", d.within_edits(F.col("a"), F.col("b"), edits)).collect()
        assert all(r.w == (distance(r.a, r.b) <= edits) for r in rows)


def classes(lines, shortest=0):
    """Least member of every line's component at two edits."""
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if min(len(x), len(y)) >= shortest and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in lines}


def found(spark, lines, shortest=0):
    df = spark.createDataFrame([(x.encode(), x) for x in lines], "id binary, line string")
    return {bytes(r.node).decode(): bytes(r.comp).decode() for r in d.edit_components(df, 2, shortest).collect()}


def test_components_are_those_of_all_pairs(spark):
    lines = sorted({x + "xyz" + y for x, y in variants(6, 150, 10)} | {y + "xyz" + x for x, y in variants(6, 150, 10)})
    want = classes(lines)
    assert found(spark, lines) == {x: c for x, c in want.items() if sum(c == w for w in want.values()) > 1}


def test_keys_of_many_lines(spark, monkeypatch):
    """Lines that share segments with all others, near only some of them: the first pivots do not settle their keys."""
    monkeypatch.setattr(d, "PIVOTS", 2)
    rng = random.Random(12)
    ends = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(40)]
    lines = sorted({f"{'the same begin ' * 2}{e} and middle{'.' * 12}" for e in ends + [e[:3] + "é" + e[4:] for e in ends] + [e[:-1] for e in ends[:20]]})
    want = classes(lines)
    assert len(set(want.values())) > 25
    assert found(spark, lines) == {x: c for x, c in want.items() if sum(c == w for w in want.values()) > 1}


def test_short_lines_are_near_none(spark):
    assert found(spark, ["abc", "abd", "x" * 30, "x" * 31], 20) == {"x" * 30: "x" * 30, "x" * 31: "x" * 30}


LICENSE = "Licensed under the usual license, version 1."
OWN = "This line stands in this document alone, it is number %d of them, and long enough to be most of the text it is in %s."


def test_repeated_lines_go_but_for_the_first(spark):
    long = "A passage of a good many words that runs on well over what a line has. " * 30
    rows = [(i, f"{OWN % (i, chr(97 + i) * 200)}\n {LICENSE[:-2]}{i}.\nown {i}\n\n" + (LICENSE if i == 8 else "")) for i in range(20)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, LICENSE), (19, rows[19][1]), (54, "Read more\ntwice\ntwice"), (55, " Read more\nshort"),
             (56, long + "ends"), (57, long[:700] + "!" + long[701:] + "ends"), (58, "short")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_removed int")
    out = d.dedup_lines(df).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        if r.doc_id in (0, 50, 51, 52, 54, 56):
            assert r.text == text[r.doc_id] and r.n_removed == 0
        elif r.doc_id in (53, 57, 58):
            assert r.text == "" and r.n_removed == 1
        elif r.doc_id == 55:
            assert r.text == "short" and r.n_removed == 1 and r.n_lines == 2
        else:
            assert r.text.split("\n")[0] == text[r.doc_id].split("\n")[0] and "icense" not in r.text and f"own {r.doc_id}" in r.text
            assert r.n_removed == (2 if r.doc_id == 8 else 1)
    assert d.dedup_lines(df.limit(0)).collect() == []


def test_copies_count_as_one_text(spark):
    rows = [(1, f"{OWN % (1, 'a')}\n{LICENSE}", 7), (2, f"{LICENSE}\n{OWN % (1, 'a')}", 7), (3, f"{OWN % (333, 'c')}\n{LICENSE}", 8), (4, LICENSE, None),
            (5, "Lone", None)]
    out = d.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, g int"), same="g").collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: rows[1][1], 3: OWN % (333, "c"), 4: "", 5: "Lone"}


def test_lines_are_shuffled_once_for_the_pairs(spark, monkeypatch):
    """Only lines that share a key with another are read to be compared, in all rounds."""
    rng, given = random.Random(9), []
    line = lambda: "".join(rng.choices("abcdefgh", k=60))
    base = [line() for _ in range(30)]
    far = [base[0][:20] + line()[:40] for _ in range(40)]  # one first segment, near none: needs further rounds
    lines = base + far + [x[:-1] + "z" for x in base[:5]]
    confirmed = d.confirmed
    monkeypatch.setattr(d, "confirmed", lambda met, texts, edits: given.append(texts.count()) or confirmed(met, texts, edits))
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(d.line_id(F.col("line")).alias("id"), "line")
    found = d.edit_components(df, 2, 20).count()
    assert found == 10
    assert len(given) > 1
    assert set(given) == {5 + 5 + 40}  # base[0] and four others, their variants, and those that share a segment


def test_letters_bound_the_edits(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(200):
        x = y = "".join(rng.choices("abcdé fgh", k=40))
        for _ in range(2):
            at = rng.randrange(len(y))
            y = rng.choice([y[:at] + y[at + 1:], y[:at] + "z" + y[at:], y[:at] + "ü" + y[at + 1:]])
        pairs.append((x, y, "".join(rng.choices("ABCDEFGHIJKLMNOP", k=40))))
    df = spark.createDataFrame(pairs, "x string, y string, far string")
    near = lambda a, b: d.may_be_near(d.letters(F.col(a)), d.letters(F.col(b)), 2)
    got = df.select(near("x", "y").alias("near"), near("x", "far").alias("far")).collect()
    assert all(r.near for r in got) and sum(r.far for r in got) < 20


def test_few_pairs_of_a_key_are_compared(spark, monkeypatch):
    """Lines that share a segment, each of its own besides: the pairs that get a row do not grow with their square."""
    rng, pairs = random.Random(4), []
    begin = "the same begin of every line "
    lines = [begin + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=58)) for _ in range(60)] + [begin + "x" * 57 + "y", begin + "x" * 58]
    confirmed = d.confirmed
    monkeypatch.setattr(d, "confirmed", lambda met, texts, edits: pairs.append(met.count()) or confirmed(met, texts, edits))
    assert set(found(spark, lines)) == set(lines[-2:])
    assert sum(pairs) < 400  # of 1891


def test_leaves_little_written(spark):
    import os
    from consensa.session import ensure_checkpoint_dir
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    df = spark.createDataFrame([(i, f"{OWN % (i, 'e')}\n{LICENSE}") for i in range(9)], "doc_id long, text string")
    assert sum(r.n_removed for r in d.dedup_lines(df).collect()) == 16  # lines under two edits apart are one
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(top)) - before}
    assert "lines-gone" in left and not left & {"lines", "line-first", "line-repeated"}
