from consensa.operators import lineage as ln

PATCH = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,4 @@ def f():
 keep
--- a dashed line goes
+++ a plus line comes
+# second
 tail
\\ No newline at end of file
@@ -10 +11 @@
-old
+new
--- /dev/null
+++ b/sub/y.py
@@ -0,0 +1,2 @@
+# first
+
--- a/z.py
+++ /dev/null
@@ -1,2 +0,0 @@
-gone
-# too
"""


def test_numbers_files_and_signs():
    assert list(ln.changed_lines(PATCH)) == [
        ("x.py", "-", 2, "-- a dashed line goes"), ("x.py", "+", 2, "++ a plus line comes"), ("x.py", "+", 3, "# second"),
        ("x.py", "-", 10, "old"), ("x.py", "+", 11, "new"), ("sub/y.py", "+", 1, "# first"), ("sub/y.py", "+", 2, ""),
        ("z.py", "-", 1, "gone"), ("z.py", "-", 2, "# too")]
    assert list(ln.changed_lines("")) == [] and list(ln.changed_lines("@@ -1 +1 @@\nbroken\n+x")) == []
    assert list(ln.changed_lines("+++ b/a\n@@ -0,0 +1,1 @@\n+one\n+not counted")) == [("a", "+", 1, "one")]


def patch(path, *hunks):
    return f"--- a/{path}\n+++ b/{path}\n" + "\n".join(hunks)


def test_as_of_introduction_and_first_change(spark):
    commits = [("r", "a1", 1, patch("p", "@@ -0,0 +1,2 @@", "+# note", "+x")), ("r", "a2", 2, patch("p", "@@ -1,1 +1,0 @@", "-# note")),
               ("r", "a3", 3, patch("p", "@@ -5,1 +5,1 @@", "-# note", "+  # note ")), ("r", "a4", 9, patch("p", "@@ -1,1 +1,0 @@", "-# note")),
               ("r", "a5", 9, patch("p", "@@ -1,1 +1,0 @@", "-# note")), ("other", "b1", 1, patch("p", "@@ -0,0 +1,1 @@", "+# note")), ("r", "n", 4, None)]
    seen = [("early", "r", "p", "# note", 1), ("late", "r", "p", "# note", 5), ("gap", "r", "p", "# note", 2), ("never", "r", "p", "# else", 5),
            ("before", "r", "p", "# note", 0), ("file", "r", "q", "# note", 5), ("x", "r", "p", " x", 50), ("null", "r", "p", None, 5)]
    out = {r.comment_id: tuple(r)[1:] for r in ln.line_lineage(
        spark.createDataFrame(seen, "comment_id string, repo string, path string, line string, seen_at int"),
        spark.createDataFrame(commits, "repo string, sha string, ts int, patch string")).collect()}
    none = (None,) * 5
    assert out == {"early": ("a1", 1, 1, "a2", 2), "late": ("a3", 3, 5, "a4", 9), "gap": ("a1", 1, 1, "a2", 2), "never": none, "before": none,
                   "file": none, "x": ("a1", 1, 2, None, None), "null": none}


def test_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, patch("p", "@@ -0,0 +1,1 @@", "+a"), "own")], "id long, patch string, line string")
    assert [tuple(r) for r in ln.diff_lines(df).collect()] == [(1, "p", "+", 1, "a")]
    assert ln.diff_lines(df.limit(0)).collect() == []
