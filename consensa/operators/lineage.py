"""Lines through the history of their files: a reader of unified diffs, and an as-of join of lines with the commits that
added and removed them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consensa.functions.text import strip_ws

#: Lines in one Arrow batch.
BATCH_LINES = 20_000
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def changed_lines(patch: str) -> Iterator[tuple[str | None, str, int, str]]:
    """``(file, sign, number, line)`` of every line that a unified diff adds (``+``: the number is that in the new file) or
    removes (``-``: in the old one).  The counts of a hunk's header say where it ends, so a removed line that begins with two
    dashes is no file header; a hunk that says less than it holds is read as far as it says."""
    old_file = file = None
    old = new = old_left = new_left = 0
    for line in patch.split("\n"):
        sign = line[:1]
        if old_left or new_left:
            if sign == "+" and new_left:
                yield file, sign, new, line[1:]
                new, new_left = new + 1, new_left - 1
                continue
            if sign == "-" and old_left:
                yield file, sign, old, line[1:]
                old, old_left = old + 1, old_left - 1
                continue
            if sign == "\\":
                continue
            if (sign == " " or not line) and old_left and new_left:
                old, new, old_left, new_left = old + 1, new + 1, old_left - 1, new_left - 1
                continue
            old_left = new_left = 0  # a broken hunk ends here
        if line.startswith("--- "):
            old_file = _name(line[4:], "a/")
        elif line.startswith("+++ "):
            file = _name(line[4:], "b/") or old_file
        elif m := _HUNK.match(line):
            old, new = int(m[1]), int(m[3])
            old_left, new_left = (1 if n is None else int(n) for n in (m[2], m[4]))


def _name(header: str, prefix: str) -> str | None:
    name = header.split("\t")[0].strip()
    return None if name == "/dev/null" else name.removeprefix(prefix)


def diff_lines(commits: DataFrame, patch_col: str = "patch") -> DataFrame:
    """A row for every line that a commit's patch adds or removes: the other columns of ``commits``, and file, sign, number
    and line.  A null patch has none."""
    names = [c for c in commits.columns if c not in (patch_col, "file", "sign", "number", "line")]
    schema = T.StructType([*(commits.schema[c] for c in names), T.StructField("file", T.StringType()), T.StructField("sign", T.StringType()),
                           T.StructField("number", T.LongType()), T.StructField("line", T.StringType())])

    def run(batches):
        import pyarrow as pa

        def out(batch, at, rows):
            own = batch.take(pa.array(at, pa.int32()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = pa.string(), pa.string(), pa.int64(), pa.string()
            return pa.RecordBatch.from_arrays([*(own.column(c) for c in names), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                                              names=[*names, "file", "sign", "number", "line"])

        for batch in batches:
            at, rows = [], []
            for i, patch in enumerate(batch.column(patch_col)):
                for row in changed_lines(patch.as_py() or ""):
                    at.append(i)
                    rows.append(row)
                    if len(rows) == BATCH_LINES:
                        yield out(batch, at, rows)
                        at, rows = [], []
            yield out(batch, at, rows)

    return commits.select(*names, patch_col).mapInArrow(run, schema)


def line_lineage(seen: DataFrame, commits: DataFrame) -> DataFrame:
    """Introduction and first change of lines as they were seen.

    ``seen(comment_id, repo, path, line, seen_at)``; ``commits(repo, sha, ts, patch)`` with unified diffs of any number of
    files.  The introduction is the last commit at or before ``seen_at`` that adds the line (blanks at its ends aside) to the
    file, the change the first one after it that removes it: a line that was removed and added again is followed from the
    addition that was in force.  Commits are in order of (ts, sha); within one, removals come before additions.

    Events and sightings are united, sorted by file, line and time, and each sighting takes the last addition before it
    (which has taken the next removal after itself): an as-of join in one sort.  Events of lines that nobody saw are left
    out before it.  All rows of ``seen`` come out, with nulls where there is no such commit."""
    key = ["repo", "path", "text"]
    events = diff_lines(commits).select("repo", F.col("file").alias("path"), strip_ws(F.col("line")).alias("text"), "ts", "sha",
                                        (F.col("sign") == "+").alias("added"), "number")
    sought = seen.select("comment_id", "repo", "path", strip_ws(F.col("line")).alias("text"), F.col("seen_at").alias("ts"))
    events = events.join(sought.select(*key).distinct(), key, "left_semi")
    both = events.withColumn("seen", F.lit(False)).unionByName(sought.withColumn("seen", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("ts", "seen", "sha", "added", "number", "comment_id")
    gone = F.first(F.when(~F.col("seen") & ~F.col("added"), F.struct("ts", "sha")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    added = F.when(~F.col("seen") & F.col("added"), F.struct("ts", "sha", "number", "gone"))
    found = both.withColumn("gone", gone).withColumn("intro", F.last(added, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("seen").select("comment_id", F.col("intro.sha").alias("intro_sha"), F.col("intro.ts").alias("intro_ts"),
                                      F.col("intro.number").alias("intro_line"), F.col("intro.gone.sha").alias("change_sha"),
                                      F.col("intro.gone.ts").alias("change_ts"))
