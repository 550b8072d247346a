"""Column expressions for text: cleaning, message normalisation, token filters, label
parsing, URL and query helpers, unified-diff features, n-grams.

Everything here is a pure ``Column -> Column`` builder over Spark built-ins (regex,
higher-order array functions), so it runs inside whole-stage code generation on the
executors and never leaves the JVM.

Unicode: the reference is Python, whose ``\\s``, ``\\w``, ``\\d`` and ``str.strip`` are
Unicode-aware, while Java's defaults are ASCII.  The classes are therefore spelled out
explicitly below (and reused verbatim by the DuckDB oracles, whose RE2 accepts the same
syntax).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ----------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ----------------------------------------------------------------------------
# Characters Python treats as whitespace (str.isspace / re \s on str).
WS = (r"\t\n\x0B\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_CLASS = f"[{WS}]"
# Python's \w on str: letters, numbers, underscore.
WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"
# Line breaks of str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# Minimal naming stop words (the reference's default list).
NAMING_STOP_WORDS = [
    "the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "by", "with", "from",
    "is", "are", "was", "were", "be", "being", "been", "this", "that", "it", "as",
    "into", "at", "over", "under", "up", "down", "out", "about", "across", "after",
    "before", "again", "further", "more", "most", "some", "such", "no", "not",
]

# Intent keywords searched in patch features, in the reference's order.
INTENT_KEYWORDS = [
    "log", "logger", "logging", "login", "auth", "authenticate",
    "error", "exception", "fail", "fix", "bug", "crash",
    "test", "ci", "build", "refactor", "perf", "optimize",
]


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def collapse_ws(c: Column) -> Column:
    """``" ".join(s.split())``: whitespace runs to one space, trimmed."""
    return strip_ws(F.regexp_replace(c, f"{WS_CLASS}+", " "))


# ----------------------------------------------------------------------------
# 10 clean_text
# ----------------------------------------------------------------------------
def clean_text(c: Column) -> Column:
    """Lowercase, every run outside ``[a-z0-9]`` to one space, trim."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


# ----------------------------------------------------------------------------
# 11 normalize_message
# ----------------------------------------------------------------------------
def normalize_message(c: Column, lowercase: bool = True, strip_refs: bool = True,
                      min_chars: int = 2) -> Column:
    """Commit-message normalisation; returns null for messages that are dropped
    (empty after stripping, or shorter than ``min_chars``)."""
    s = strip_ws(F.coalesce(c, F.lit("")))
    if lowercase:
        s = F.lower(s)
    if strip_refs:
        # one trailing "(#123)", then every "#123" ending at a word boundary
        s = F.regexp_replace(s, rf"{WS_CLASS}*\(#\p{{Nd}}+\){WS_CLASS}*$", "")
        s = F.regexp_replace(s, rf"#\p{{Nd}}+(?!{WORD_CLASS})", "")
    s = collapse_ws(s)
    return F.when(F.length(s) >= F.lit(max(min_chars, 1)), s)


# ----------------------------------------------------------------------------
# 12 filter_tokens / 13 normalize_tokens / word tokens
# ----------------------------------------------------------------------------
def word_tokens(c: Column, lowercase: bool = True) -> Column:
    """Runs of word characters (letters, numbers, underscore); punctuation and symbols
    never form tokens."""
    s = F.lower(c) if lowercase else c
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(f"{WORD_CLASS}+"), 0)


def filter_tokens(tokens: Column, stop_words: list[str] | None = None, min_len: int = 2) -> Column:
    """Drop stop words, number-like tokens and tokens shorter than ``min_len``."""
    stops = F.array(*[F.lit(w) for w in (stop_words if stop_words is not None else NAMING_STOP_WORDS)])
    return F.filter(tokens, lambda t: (~F.array_contains(stops, t))
                    & (~t.rlike(r"^\p{N}+$")) & (F.length(t) >= min_len))


def drop_stop_words(tokens: Column, stop_words: list[str] | None = None) -> Column:
    """Drop stop words alone; numbers stay, as in a count vectorizer."""
    stops = F.array(*[F.lit(w) for w in (stop_words if stop_words is not None else NAMING_STOP_WORDS)])
    return F.filter(tokens, lambda t: ~F.array_contains(stops, t))


def normalize_tokens(tokens: Column, lemmas: dict[str, str], min_len: int = 1) -> Column:
    """Replace every token found in the (small, fixed) lemma table; order kept.  ``min_len`` is
    the least length of a lemma, not of its token."""
    out = tokens
    if lemmas:
        m = F.create_map(*[x for k, v in sorted(lemmas.items()) for x in (F.lit(k), F.lit(v))])
        out = F.transform(tokens, lambda t: F.coalesce(m[t], t))
    return F.filter(out, lambda t: F.length(t) >= min_len) if min_len > 1 else out


def vectorizer_tokens(clean: Column) -> Column:
    """Tokens of already-cleaned text (``[a-z0-9 ]``) with 2+ characters, like a default
    count vectorizer."""
    return F.filter(F.split(clean, " "), lambda t: F.length(t) >= 2)


# ----------------------------------------------------------------------------
# 40 n-grams
# ----------------------------------------------------------------------------
def _gram_builder(n: int):
    fields = [str(k) for k in range(n)]

    def build(s, i):
        return F.struct(F.lit(n).alias("n"), (i + 1).alias("pos"),
                        F.concat_ws(" ", *[s[f] for f in fields]).alias("gram"))
    return build


def gram_strings(tokens: Column, n_min: int = 1, n_max: int = 2) -> Column:
    """All n-grams for ``n`` in ``[n_min, n_max]`` as a plain ``array<string>`` (for
    counting, where positions are not needed)."""
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(tokens)
            continue
        m = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        z = F.arrays_zip(*[F.slice(tokens, k + 1, m) for k in range(n)])
        fields = [str(k) for k in range(n)]
        g = F.transform(z, _join_fields(fields))
        parts.append(F.when(F.size(tokens) >= n, g).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _join_fields(fields: list[str]):
    def join(e):
        return F.concat_ws(" ", *[e[f] for f in fields])
    return join


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 2) -> Column:
    """All n-grams for ``n`` in ``[n_min, n_max]`` as ``array<struct<n, pos, gram>>``.

    Built from ``n`` shifted slices zipped together (linear in the text length).  A text
    shorter than ``n`` yields no n-gram of that size."""
    parts = []
    for n in range(n_min, n_max + 1):
        m = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        shifted = [F.slice(tokens, k + 1, m) for k in range(n)]
        z = F.arrays_zip(*shifted) if n > 1 else F.transform(tokens, lambda t: F.struct(t.alias("0")))
        grams = F.transform(z, _gram_builder(n))
        parts.append(F.when(F.size(tokens) >= n, grams)
                     .otherwise(F.array().cast("array<struct<n:int,pos:int,gram:string>>")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


# ----------------------------------------------------------------------------
# 14 parse_llm_label, 15 query_pattern, 16 repo_from_url
# ----------------------------------------------------------------------------
def parse_llm_label(c: Column) -> Column:
    """Label from an LLM answer such as ``{"category": "Testing"}``: split on ``:``,
    only answers with exactly two parts count (else null), non-word edges stripped."""
    parts = F.split(c, ":", -1)
    lab = F.regexp_replace(F.get(parts, 1), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(F.size(parts) == 2, lab)


def query_pattern(q: Column) -> Column:
    """Search query -> phrase: drop the last space-separated word, remove quotes, lowercase."""
    words = F.split(q, " ", -1)
    head = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.lower(F.regexp_replace(F.array_join(head, " "), '"', ""))


def repo_from_url(url: Column) -> Column:
    """``owner/name`` from the 4th and 5th ``/``-segments of an HTML URL (null if absent)."""
    seg = F.split(url, "/", -1)
    return F.when(F.size(seg) >= 5, F.concat_ws("/", F.get(seg, 3), F.get(seg, 4)))


# ----------------------------------------------------------------------------
# 18 patch_features / 19 compose_doc_text
# ----------------------------------------------------------------------------
def with_patch_features(df: DataFrame, patch_col: str, out_col: str = "patch_feat",
                        max_files: int = 10, max_added: int = 10, max_removed: int = 10,
                        max_chars: int = 1500, include_files: bool = True,
                        include_added_removed: bool = True, include_keywords: bool = True,
                        keywords: list[str] | None = None, whole_word_keywords: bool = False,
                        count_headers: bool = True) -> DataFrame:
    """Add compact signals of a unified diff, same rules as the reference:

    * ``+++ b/<path>`` (or ``+++ <path>``) lines name files, distinct, until ``max_files``
      distinct files were seen; later header lines fall through to the line rules.
    * ``+x`` (not ``++++``-prefixed) adds ``x``, ``-x`` (not ``----``) removes ``x``,
      stripped, first ``max_added`` / ``max_removed`` kept.  A ``--- a/x`` header counts as a
      removed line ``-- a/x``, exactly as in the reference.
    * keywords: each intent keyword that occurs as a substring of the lower-cased kept
      files/lines, sorted.
    * sections joined by `` | `` and cut at ``max_chars``.

    Options beyond the reference: ``whole_word_keywords`` matches keywords only as whole
    words (the reference finds ``ci`` inside ``decide``); ``count_headers=False`` keeps
    ``--- a/x`` / ``+++ b/x`` header lines out of the added/removed lines.

    Built as staged projections of row-local array functions: every intermediate array is
    computed once per row and lambdas only touch their own element.
    """
    kws = keywords if keywords is not None else INTENT_KEYWORDS
    keep = df.columns
    hdr_re = rf"^\+\+\+{WS_CLASS}+(.+)$"
    hdr_b = rf"^\+\+\+{WS_CLASS}+b/(.+)$"
    empty = F.array().cast("array<string>")
    s1 = df.withColumn("_p", strip_ws(F.coalesce(F.col(patch_col), F.lit(""))))
    s1 = s1.withColumn("_lines", F.transform(F.split("_p", LINE_BREAK, -1),
                                             lambda l, i: F.struct(i.alias("i"), l.alias("l"),
                                                                   l.rlike(hdr_re).alias("h"))))
    if include_files:
        s2 = s1.withColumn("_named", F.filter(F.transform(F.filter("_lines", lambda x: x["h"]), lambda x: F.struct(
            x["i"].alias("i"),
            strip_ws(F.when(x["l"].rlike(hdr_b), F.regexp_extract(x["l"], hdr_b, 1))
                     .otherwise(F.regexp_extract(x["l"], hdr_re, 1))).alias("f"))), lambda h: h["f"] != ""))
        s2 = s2.withColumn("_nf", F.transform("_named", lambda h: h["f"]))
        s2 = s2.withColumn("_dist", F.array_distinct("_nf"))
        # line index where the max_files-th distinct file first appears (collection stops there)
        cap_pos = F.array_position("_nf", F.get(F.col("_dist"), max_files - 1))
        s2 = s2.withColumn("_cap", F.when(cap_pos > 0, F.element_at("_named", cap_pos.cast("int"))["i"])
                           .otherwise(F.lit(2147483647)))
        s2 = s2.withColumn("_files", F.slice("_dist", 1, max_files))
        s2 = s2.withColumn("_content", F.filter(
            F.arrays_zip(F.col("_lines").alias("x"), F.array_repeat("_cap", F.size("_lines")).alias("c")),
            lambda z: ~(z["x"]["h"] & (z["x"]["i"] <= z["c"]))))
        s2 = s2.withColumn("_content", F.transform("_content", lambda z: z["x"]["l"]))
    else:
        s2 = s1.withColumn("_files", empty).withColumn("_content", F.transform("_lines", lambda x: x["l"]))
    if not count_headers:
        s2 = s2.withColumn("_content", F.filter("_content", lambda l: ~l.rlike(rf"^(\+\+\+|---){WS_CLASS}")))
    if include_added_removed:
        s3 = s2.withColumn("_added", F.slice(F.transform(F.filter("_content", lambda l: l.rlike(r"^\+(?!\+\+\+)")),
                                                         lambda l: strip_ws(F.substring(l, 2, 1 << 30))), 1, max_added))
        s3 = s3.withColumn("_removed", F.slice(F.transform(F.filter("_content", lambda l: l.rlike(r"^-(?!---)")),
                                                           lambda l: strip_ws(F.substring(l, 2, 1 << 30))), 1, max_removed))
    else:
        s3 = s2.withColumn("_added", empty).withColumn("_removed", empty)
    if include_keywords:
        blob = F.lower(F.array_join(F.concat("_files", "_added", "_removed"), " "))
        s3 = s3.withColumn("_blob", blob)
        kw_arr = F.array(*[F.lit(k) for k in kws])
        z = F.arrays_zip(kw_arr.alias("k"), F.array_repeat("_blob", len(kws)).alias("b"))
        if whole_word_keywords:
            words = F.split(F.col("_blob"), f"{NON_WORD_CLASS}+")
            z = F.arrays_zip(kw_arr.alias("k"), F.array_repeat(words, len(kws)).alias("b"))
            found = F.filter(z, lambda e: F.array_contains(e["b"], e["k"]))
        else:
            found = F.filter(z, lambda e: F.instr(e["b"], e["k"]) > 0)
        s3 = s3.withColumn("_hits", F.array_sort(F.array_distinct(F.transform(found, lambda e: e["k"]))))
    else:
        s3 = s3.withColumn("_hits", empty)
    sections = F.array(
        F.when(F.size("_files") > 0, F.concat(F.lit("FILES: "), F.array_join("_files", " "))),
        F.when(F.size("_added") > 0, F.concat(F.lit("ADDED: "), F.array_join("_added", " ; "))),
        F.when(F.size("_removed") > 0, F.concat(F.lit("REMOVED: "), F.array_join("_removed", " ; "))),
        F.when(F.size("_hits") > 0, F.concat(F.lit("KEYWORDS: "), F.array_join("_hits", " "))),
    )
    out = F.when(F.length("_p") == 0, F.lit("")).otherwise(
        F.substring(F.array_join(sections, " | "), 1, max_chars))  # null sections are skipped
    return s3.select(*keep, out.alias(out_col))


def decode_content(b64: Column) -> Column:
    """File content delivered base64-encoded (as by code-host APIs) -> UTF-8 text."""
    return F.unbase64(b64).cast("string")


def compose_doc_text(message: Column, features: Column, prefix: str | None = None) -> Column:
    """``message [PATCH] features`` when features are present, optional constant prefix."""
    doc = F.when(F.coalesce(F.length(features), F.lit(0)) > 0,
                 F.concat(message, F.lit(" [PATCH] "), features)).otherwise(message)
    return F.concat(F.lit(prefix), doc) if prefix else doc


# ----------------------------------------------------------------------------
# 17 extract_comments (native form for markup; the scanner is in operators/comments.py)
# ----------------------------------------------------------------------------
def markup_comments(text: Column) -> Column:
    """``<!-- ... -->`` comments of a markup text as ``array<struct<line, comment>>``;
    ``line`` is 1 + the number of line breaks before the comment starts."""
    parts = F.split(F.coalesce(text, F.lit("")), "<!--", -1)
    nl = F.transform(parts, lambda p: F.size(F.split(p, "\n", -1)) - 1)
    # running line number at the start of every part (prefix sums, built once)
    starts = F.aggregate(nl, F.array(F.lit(1)),
                         lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    z = F.arrays_zip(parts.alias("p"), F.slice(starts, 1, F.size(parts)).alias("line"))
    with_idx = F.transform(z, lambda e, i: F.struct(i.alias("i"), e["p"].alias("p"), e["line"].alias("line")))
    closed = F.filter(with_idx, lambda x: (x["i"] > 0) & (F.instr(x["p"], "-->") > 0))
    return F.transform(closed, lambda x: F.struct(
        x["line"].alias("line"),
        strip_ws(F.concat(F.lit("<!--"), F.substring_index(x["p"], "-->", 1), F.lit("-->"))).alias("comment")))
