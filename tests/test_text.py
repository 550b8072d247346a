"""Text expressions on inline rows, one test per reference quirk."""

import pytest
from pyspark.sql import functions as F

from consensa.functions import text as T
from consensa.operators.comments import extract_comments


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("s")).alias("r")).first()["r"]


def test_clean_text(spark):
    assert one(spark, T.clean_text, "  Fix: Bug #12 — café!! ") == "fix bug 12 caf"


@pytest.mark.parametrize("raw,expected", [
    ("Fix thing (#123)", "fix thing"),
    ("Fix (#1) and more (#2)", "fix () and more"),        # earlier (#n) becomes ()
    ("Refs #45, see #7b", "refs , see #7b"),               # #7b is not followed by a boundary
    ("\t Add feature\n\n", "add feature"),             # Unicode whitespace
    ("ab", None),                                           # under min_chars
    ("   ", None),
])
def test_normalize_message(spark, raw, expected):
    assert one(spark, lambda c: T.normalize_message(c, min_chars=4), raw) == expected


def test_filter_and_normalize_tokens(spark):
    toks = lambda c: F.array_join(T.normalize_tokens(T.filter_tokens(T.word_tokens(c)), {"went": "go"}), " ")
    assert one(spark, toks, "The cat went to 42 places, a b cc!") == "cat go places cc"


@pytest.mark.parametrize("raw,expected", [
    ('{"category": "Testing"}', "Testing"),
    ('{"category": "Bug Identification & Fixing"}', "Bug Identification & Fixing"),
    ('{"category": "a:b"}', None),                          # three parts -> dropped
    ('{"category": "_Doc_"}', "Doc"),                       # underscores stripped
    ('{"category": "Éte"}', "Éte"),                         # Unicode letter kept
])
def test_parse_llm_label(spark, raw, expected):
    assert one(spark, T.parse_llm_label, raw) == expected


def test_query_pattern_and_repo(spark):
    assert one(spark, T.query_pattern, '"Generated By" language:Python') == "generated by"
    assert one(spark, T.repo_from_url, "https://github.com/own/name/blob/main/x.py") == "own/name"
    assert one(spark, T.repo_from_url, "https://x") is None


PATCH = """--- a/src/app.py
+++ b/src/app.py
@@ -1,3 +1,3 @@
-import logging
+import logger
 context line
+Decide the CI build
-old
"""


def feats(spark, patch, **kw):
    df = spark.createDataFrame([(patch,)], "patch string")
    return T.with_patch_features(df, "patch", **kw).first()["patch_feat"]


def test_patch_features_rules(spark):
    out = feats(spark, PATCH)
    # the --- header counts as a removed line, as in the reference
    assert out == ("FILES: src/app.py | ADDED: import logger ; Decide the CI build | "
                   "REMOVED: -- a/src/app.py ; import logging ; old | KEYWORDS: build ci log logger logging")


def test_patch_features_file_cap_and_cut(spark):
    p = "\n".join(f"+++ b/f{i}.py\n+x{i}" for i in range(4))
    out = feats(spark, p, max_files=2, max_added=3)
    assert out == "FILES: f0.py f1.py | ADDED: x0 ; x1 ; ++ b/f2.py"
    assert feats(spark, p, max_files=2, max_added=3, max_chars=30) == out[:30]
    assert feats(spark, "   ") == ""


def test_ngrams_guarded(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["solo"],)], "t array<string>")
    rows = df.select(F.inline(T.ngrams(F.col("t"), 1, 3))).collect()
    grams = sorted((r["n"], r["gram"]) for r in rows)
    assert (2, "solo") not in grams and (3, "a b c") in grams and len(grams) == 3 + 2 + 1 + 1


def test_markup_and_line_comments(spark):
    html = "<p>x</p>\n<!-- one -->\n<div><!-- two\nlines --></div><!-- open"
    rows = spark.createDataFrame([(html,)], "s string").select(F.inline(T.markup_comments(F.col("s")))).collect()
    assert [(r["line"], r["comment"]) for r in rows] == [(2, "<!-- one -->"), (3, "<!-- two\nlines -->")]


def test_comment_scanner(spark):
    py = ("x = 1  # set x\ns = 'a # not' # real\n# whole line\nt = \"# no\"\nd = \'\'\'one\n# inside\n\'\'\' # after\n"
          "e = 'it\\'s' # escaped\nopen = 'no end # x\n#last\n\"\"\"never closed # no")
    js = ("a = 1; /* one\ntwo */ b = 'it\\'s'; // after\nc = `t // no\n/* no */`; // yes\nd = 6 / 2 / 1; e = \"/* no */\"\n/* open")
    page = "<!-- one -->\n<!-- two\nlines --> x <!-- open"
    df = spark.createDataFrame([(1, py), (2, js), (3, page), (4, None), (5, "")], "id long, s string")
    got = {}
    for i, style in ((1, "hash"), (2, "slash"), (3, "markup")):
        rows = extract_comments(df, ["id"], "s", style).collect()
        got[style] = [(r["line"], r["comment"]) for r in rows if r["id"] == i]
        source = {1: py, 2: js, 3: page}[i]
        assert all(source[r["start"]:].startswith(r["comment"]) for r in rows if r["id"] == i)
        assert not any(r["id"] in (4, 5) for r in rows)
    assert got["hash"] == [(1, "# set x"), (2, "# real"), (3, "# whole line"), (7, "# after"), (8, "# escaped"), (10, "#last")]
    assert got["slash"] == [(1, "/* one\ntwo */"), (2, "// after"), (4, "// yes"), (6, "/* open")]
    assert got["markup"] == [(1, "<!-- one -->"), (2, "<!-- two\nlines -->")]


def test_patch_options_and_base64(spark):
    out = feats(spark, PATCH, whole_word_keywords=True, count_headers=False)
    assert out == ("FILES: src/app.py | ADDED: import logger ; Decide the CI build | "
                   "REMOVED: import logging ; old | KEYWORDS: build ci logger logging")
    df = spark.createDataFrame([("eCA9IDEgICMgaGk=",)], "b string")
    assert df.select(T.decode_content(F.col("b"))).first()[0] == "x = 1  # hi"
