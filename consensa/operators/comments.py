"""Comments of source files: one linear scan per file.

Strings are read whole (escapes, Python's triple quotes, JavaScript's templates), so a marker inside of
one starts no comment.  A quote that its line does not close ends with the line, as an editor shows it; an
unclosed triple quote, template or block comment ends with the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTED = r"""'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)"""
#: The comment is the first group.
STYLES = {
    "hash": rf"""'''(?:\\.|(?!''').)*(?:'''|\Z)|\"\"\"(?:\\.|(?!\"\"\").)*(?:\"\"\"|\Z)|{_QUOTED}|(#[^\n]*)""",
    "slash": rf"`(?:\\.|[^`\\])*(?:`|\Z)|{_QUOTED}|(//[^\n]*|/\*.*?(?:\*/|\Z))",
    "markup": r"(<!--.*?-->)",
}


def extract_comments(files: DataFrame, key_cols: list[str], text_col: str, style: str = "hash") -> DataFrame:
    """``(*key_cols, line, start, comment)``: the line (from 1) and character offset where each comment starts, and
    its text, trimmed.  Null text has none.  Row-local; works on streams as well."""
    pattern = STYLES[style]
    keyed = files.select(*key_cols, F.col(text_col).cast("string").alias("__source"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1])

    def run(batches):
        import re

        import pyarrow as pa
        find = re.compile(pattern, re.S).finditer
        for batch in batches:
            row, line, start, comment = [], [], [], []
            for i, text in enumerate(batch.columns[-1]):
                source, now, seen = text.as_py() or "", 1, 0
                for m in find(source):
                    if m[1] is not None:
                        now += source.count("\n", seen, m.start())
                        seen = m.start()
                        row.append(i), line.append(now), start.append(seen), comment.append(m[1].strip())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(take) for c in batch.columns[:-1]), pa.array(line, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(comment, pa.string())], names=[*batch.schema.names[:-1], "line", "start", "comment"])

    return keyed.mapInArrow(run, f"{fields}, line int, start long, comment string")
