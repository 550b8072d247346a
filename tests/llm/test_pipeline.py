import corpus_pipeline as c
from consensa.llm.common import read

SF = "/root/testdata/sf0.001"
LONG = ("The first of these documents has a handful of plain sentences with enough different words in them so that no "
        "rule finds fault with it, number {} it is, and nothing in it is repeated anywhere else in this small table, "
        "as {} may be seen by {} reading it aloud to the end where it stops.")


def test_stages(spark):
    item = read(spark, SF, "benchmark").first().text
    texts = {1: LONG.format(1, "it", "any"), 2: LONG.format(1, "it", "any"), 3: LONG.format("seven", "that", "someone patiently"),
             4: LONG.format(3, "all", "anyone who is") + " " + item, 5: "too short", 6: None, 7: "", 8: "| a $ b " * 30}
    rows = [(k, t, "en", None, None) for k, t in texts.items()] + [(1, texts[1], None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [[1, 1, 2, 3, 4], [1, 1, 2, 3, 4], [1, 3, 4], [1, 3]]
    for (name, stage), ids in zip(c.STAGES, want, strict=False):
        docs = stage(spark, docs, SF)
        assert docs.columns == c.COLUMNS, name
        kept = docs.collect()
        assert sorted(r.doc_id for r in kept) == ids, name
        assert all(r.text == texts[r.doc_id] for r in kept)
    pieces = c.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {1, 3}


def test_line_stage_takes_every_repeat(spark):
    notice = "This notice of fifty words or so stands in two documents and is most of the text of either of them."
    own = [f"Text {i} has but this line {'abc'[i] * 30}." for i in range(3)]
    texts = {1: f"{own[0]}\n{notice}", 2: f"{notice}\n{own[1]}", 3: f"{notice[:-1]}!\n{own[2]}",
             4: f"{own[1]}\n{notice}", 5: notice, 6: f"{own[0]}\n{notice}", 7: None}
    rows = [(k, t, "en", None, None) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in c.line_stage(spark, docs, SF).collect()}
    # 1 and 6 are one text, which has the first notice; nothing is left of 4 and 5
    assert got == {1: texts[1], 2: own[1], 3: own[2], 6: texts[6], 7: None}


def test_near_copies_reach_the_near_stage_whole(spark):
    lines = [f"Line {i} of a longer text says something of its own about {w} and then stops here." for i, w in enumerate(
        "ash bay cat dam elm fig gum hat ivy jam kit log map nut oak pan quay rue sun tin urn van wax yew".split())]
    changed = list(lines)
    changed[7] = "What stood in this place has been written anew by someone who had quite another thing to say."
    rows = [(1, "\n".join(lines)), (2, "\n".join(changed)), (3, "\n".join([lines[3], "A text that has one line of the others and this one."]))]
    docs = spark.createDataFrame([(k, t, "en", None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lined = c.line_stage(spark, docs, SF)
    assert {r.doc_id: r.text.count("\n") for r in lined.collect()} == {1: 23, 2: 23, 3: 0}
    assert sorted(r.doc_id for r in c.near_stage(spark, lined, SF).collect()) == [1, 3]


def test_near_stage_takes_pairs_from_80_percent(spark):
    words = [f"w{i}" for i in range(104)]
    texts = {1: words, 2: words[:90] + [f"x{i}" for i in range(10)],  # 86 of 110 shingles: 0.78
             3: [f"y{i}" for i in range(104)], 4: [f"y{i}" for i in range(94)] + [f"z{i}" for i in range(10)]}  # 90 of 110: 0.82
    rows = [(k, " ".join(w), "en", None, None) for k, w in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in c.near_stage(spark, docs, SF).collect()) == [1, 2, 3]


def test_run_and_empty_documents(spark):
    pieces = c.run(spark, SF).collect()
    n = read(spark, SF, "documents").count()
    assert 0 < len({r.doc_id for r in pieces}) < n
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert {"pipeline", *(f"op{i}_" for i in range(1, 11))} <= {"pipeline"} | {n.split("_")[0] + "_" for n in names}
