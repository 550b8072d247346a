import re
from collections import Counter

from consensa.llm import quality_rules as q

TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h " * 3, "x | y | z " * 10, "Ha " * 40,
         "plain words without any repeated window of eight in a row make a text that is kept because "
         "nothing about it is odd and it has enough of them",
         "line one here\nline two here\nline one here\n\nline one here\nline two here " + "w " * 20,
         "LOUD WORDS EVERYWHERE IN THIS TEXT AND NOT A SINGLE ONE OF THEM IS QUIET AT ALL SO IT IS DROPPED NOW OK",
         "wörd ñandú éa\x0bb\x0cc\rd " * 9 + " x"]


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def test_counts_against_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "one", "clash"), (None, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = q.quality_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert not (r.base_failed and r.kept)
    kept = {r.text for r in got if r.kept}
    assert TEXTS[7] in kept and TEXTS[5] not in kept and TEXTS[9] not in kept


def test_order_does_not_change_the_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    first = {(r.doc_id, r.kept) for r in q.quality_rules(df).collect()}
    assert first == {(r.doc_id, r.kept) for r in q.quality_rules(df, rules=q.RULES[::-1], sample_rows=2).collect()}


def test_cheap_and_selective_rules_come_first(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS * 20], "text string")
    never = q.Rule("never", lambda c: c["n_words"] < 0)
    always = q.Rule("always", lambda c: c["n_words"] >= 0)
    assert [r.name for r in q.order_rules(df, [never, always])] == ["always", "never"]


def test_empty_table(spark):
    assert q.quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_few_words_in_a_text_of_any_length(spark):
    import random
    rng = random.Random(4)
    few = [f"word{i}" for i in range(10)]
    many = [f"term{i}" for i in range(20_000)]
    lengths = [100, 200, 201, 1000, 100_000]
    # ten words in random order, and a vocabulary that grows with the root of the text
    rows = [(i, " ".join(rng.choices(few, k=n))) for i, n in enumerate(lengths)]
    rows += [(i, " ".join(rng.choices(many[:int(10 * n ** 0.5)], k=n))) for i, n in enumerate(lengths, 100)]
    got = {r.doc_id: r.kept for r in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i >= 100 for i, _ in rows}


def test_the_sample_is_drawn_from_the_whole_table(spark):
    late = q.Rule("late", lambda c: c["t"] == "!")
    seen = q.order_rules(spark.range(20_000).selectExpr("if(id < 19000, 'a', '!') AS text").coalesce(1),
                         [q.Rule("never", lambda c: c["n_words"] < 0), late])
    assert [r.name for r in seen] == ["late", "never"]
    assert q.order_rules(spark.createDataFrame([], "text string"), [late]) == [late]
