"""Registered text queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.functions import text as T
from consensa.operators import mining
from consensa.operators.comments import extract_comments
from consensa.plans import sqlfrag as S
from consensa.session import table

MIN_CHARS = 4
# The first marker of a line outside single- or double-quoted strings (for the oracle).
HASH_COMMENT_RE = r"""^[^'"#]*(?:(?:'[^']*'|"[^"]*")[^'"#]*)*(#.*)$"""
# Fixed lemma table of the token-normalisation fixture.
LEMMAS = {
    "has": "have", "had": "have", "does": "do", "did": "do", "done": "do",
    "better": "good", "best": "good", "children": "child", "men": "man", "women": "woman",
    "went": "go", "gone": "go", "made": "make", "said": "say", "found": "find",
    "est": "être", "sont": "être", "ist": "sein", "sind": "sein", "es": "ser",
}
# Phrase grid fixture: "A B" and "B C A" per language.
PHRASE_A = ["and", "in", "on", "of"]
PHRASE_B = ["the"]
PHRASE_C = ["same", "other"]


# ------------------------------------------------------------------ fixtures
def commit_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The whole document text with `` (#<doc_id>)`` appended; odd ids also carry ``#<doc_id>``."""
    d = table(spark, sf, "documents")
    pre = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("Fix #"), F.col("doc_id").cast("string"), F.lit(" "))) \
        .otherwise(F.lit(""))
    return d.select("doc_id", F.concat(pre, F.col("text"), F.lit(" (#"), F.col("doc_id").cast("string"), F.lit(")"))
                    .alias("message"))


COMMIT_MESSAGES_SQL = """
    SELECT doc_id, (CASE WHEN doc_id % 2 = 1 THEN 'Fix #' || CAST(doc_id AS VARCHAR) || ' ' ELSE '' END)
           || text || ' (#' || CAST(doc_id AS VARCHAR) || ')' AS message
    FROM documents
"""


def document_patches(spark: SparkSession, sf: str) -> DataFrame:
    """A unified diff per document: file headers, a hunk line, then every text line signed
    by position (+, -, space) with an extra ``+++ b/f<i>.py`` header before every 4th line."""
    d = table(spark, sf, "documents")
    lines = F.split("text", "\n", -1)
    signs = F.array(F.lit("+"), F.lit("-"), F.lit(" "))
    signed = F.transform(lines, lambda l, i: F.concat(
        F.when(i % 4 == 3, F.concat(F.lit("+++ b/f"), i.cast("string"), F.lit(".py\n"))).otherwise(F.lit("")),
        F.element_at(signs, (i % 3 + 1).cast("int")), l))
    name = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".py"))
    patch = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1 +1 @@\n"),
                     F.array_join(signed, "\n"))
    return d.select("doc_id", patch.alias("patch"))


PATCHES_SQL = """
    SELECT doc_id,
           '--- a/' || source || '/doc' || CAST(doc_id AS VARCHAR) || '.py' || chr(10) ||
           '+++ b/' || source || '/doc' || CAST(doc_id AS VARCHAR) || '.py' || chr(10) ||
           '@@ -1 +1 @@' || chr(10) ||
           array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
               (CASE WHEN (i - 1) % 4 = 3 THEN '+++ b/f' || CAST(i - 1 AS VARCHAR) || '.py' || chr(10) ELSE '' END)
               || (['+', '-', ' '])[((i - 1) % 3) + 1] || l), chr(10)) AS patch
    FROM documents
"""


def phrase_grid_frame(spark: SparkSession, sf: str) -> DataFrame:
    langs = table(spark, sf, "documents").select(F.col("lang").alias("language")).distinct()
    return mining.phrase_grid(langs, PHRASE_A, PHRASE_B, PHRASE_C)


GRID_SQL = f"""
    WITH langs AS (SELECT DISTINCT lang AS language FROM documents),
    a AS (SELECT unnest({S.str_list(PHRASE_A)}) AS a), b AS (SELECT unnest({S.str_list(PHRASE_B)}) AS b),
    c AS (SELECT unnest({S.str_list(PHRASE_C)}) AS c)
    SELECT '"' || a || ' ' || b || '" language:' || language AS query, a || ' ' || b AS phrase, language
    FROM langs, a, b
    UNION ALL
    SELECT '"' || b || ' ' || c || ' ' || a || '" language:' || language, b || ' ' || c || ' ' || a, language
    FROM langs, b, c, a
"""


# ------------------------------------------------------------------ queries
def q_clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


def q_normalize_message(spark, sf):
    m = commit_messages(spark, sf)
    out = m.select("doc_id", T.normalize_message(F.col("message"), min_chars=MIN_CHARS).alias("message"))
    return out.filter(F.col("message").isNotNull())


def q_filter_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(T.filter_tokens(T.word_tokens(F.col("text"))), " ").alias("tokens"))


def q_normalize_tokens(spark, sf):
    d = table(spark, sf, "documents")
    toks = T.normalize_tokens(T.filter_tokens(T.word_tokens(F.col("text")), min_len=1), LEMMAS, min_len=2)
    return d.select("doc_id", F.array_join(toks, " ").alias("tokens"))


def llm_outputs(spark, sf):
    o = table(spark, sf, "orders")
    extra = F.when(F.col("o_orderkey") % 7 == 0, F.lit(":extra")).otherwise(F.lit(""))
    return o.select(F.col("o_orderkey").alias("item_id"),
                    F.concat(F.lit('{"category": "'), F.col("o_orderpriority"), extra, F.lit('"}')).alias("llm_output"))


def q_parse_llm_label(spark, sf):
    lab = llm_outputs(spark, sf).select("item_id", T.parse_llm_label(F.col("llm_output")).alias("label"))
    return lab.filter(F.col("label").isNotNull())


def q_query_pattern(spark, sf):
    g = phrase_grid_frame(spark, sf)
    return g.select("query", T.query_pattern(F.col("query")).alias("pattern"))


def q_repo_from_url(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.repo_from_url(F.col("url")).alias("repo_full_name"))


def q_extract_comments(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.inline(T.markup_comments(F.col("html"))))


def python_sources(spark, sf):
    """Source text per document: every third line (2, 5, 8, ... from 0) turned into a comment."""
    d = table(spark, sf, "documents")
    lines = F.split("text", "\n", -1)
    src = F.array_join(F.transform(lines, lambda l, i: F.when(i % 3 == 2, F.concat(F.lit("# "), l)).otherwise(l)), "\n")
    return d.select("doc_id", src.alias("source"))


def q_extract_line_comments(spark, sf):
    s = python_sources(spark, sf)
    return extract_comments(s, ["doc_id"], "source", "hash").select("doc_id", "line", "comment")


def q_patch_features(spark, sf):
    return T.with_patch_features(document_patches(spark, sf), "patch").select("doc_id", "patch_feat")


def q_compose_doc_text(spark, sf):
    m = commit_messages(spark, sf).select(
        "doc_id", T.normalize_message(F.col("message"), min_chars=MIN_CHARS).alias("message"))
    p = T.with_patch_features(document_patches(spark, sf), "patch").select("doc_id", "patch_feat")
    j = m.filter(F.col("message").isNotNull()).join(p, "doc_id")
    return j.select("doc_id", T.compose_doc_text(F.col("message"), F.col("patch_feat")).alias("doc_text"))


def q_ngrams(spark, sf):
    d = table(spark, sf, "documents")
    toks = T.drop_stop_words(T.vectorizer_tokens(T.clean_text(F.col("text"))))
    return d.select("doc_id", F.inline(T.ngrams(toks, 1, 2)))


QUERIES = {
    "clean_text": q_clean_text,
    "normalize_message": q_normalize_message,
    "filter_tokens": q_filter_tokens,
    "normalize_tokens": q_normalize_tokens,
    "parse_llm_label": q_parse_llm_label,
    "query_pattern": q_query_pattern,
    "repo_from_url": q_repo_from_url,
    "extract_comments": q_extract_comments,
    "extract_line_comments": q_extract_line_comments,
    "patch_features": q_patch_features,
    "compose_doc_text": q_compose_doc_text,
    "ngrams": q_ngrams,
}


# ------------------------------------------------------------------ oracles
WS = T.WS_CLASS
WORD = T.WORD_CLASS


def _norm_msg_sql() -> str:
    s1 = f"lower({S.strip_ws('message')})"
    s2 = f"regexp_replace({s1}, {S.lit(WS + '*' + chr(92) + '(#' + chr(92) + 'p{Nd}+' + chr(92) + ')' + WS + '*$')}, '')"
    s3 = f"regexp_replace({s2}, {S.lit('#' + chr(92) + 'p{Nd}+(' + T.NON_WORD_CLASS + '|$)')}, {S.lit(chr(92) + '1')}, 'g')"
    s4 = S.collapse_ws(s3)
    return f"WITH src AS ({COMMIT_MESSAGES_SQL}), n AS (SELECT doc_id, {s4} AS message FROM src) " \
           f"SELECT doc_id, message FROM n WHERE length(message) >= {MIN_CHARS}"


_STOPS = S.str_list(T.NAMING_STOP_WORDS)
_TOKENS = (f"list_filter(regexp_extract_all(lower(text), {S.lit(WORD + '+')}), lambda t: "
           f"NOT list_contains({_STOPS}, t) AND NOT regexp_full_match(t, {S.lit(chr(92) + 'p{N}+')}) "
           f"AND length(t) >= 2)")


def _lemma_case(v: str) -> str:
    whens = " ".join(f"WHEN {S.lit(k)} THEN {S.lit(x)}" for k, x in sorted(LEMMAS.items()))
    return f"CASE {v} {whens} ELSE {v} END"


_HDR = S.lit(r"^\+\+\+" + WS + "+(.+)$")
_HDR_B = S.lit(r"^\+\+\+" + WS + "+b/(.+)$")
_LB = S.lit(T.LINE_BREAK)


def _patch_sql(patch_src: str) -> str:
    kws = " UNION ALL ".join(f"SELECT {S.lit(k)} AS kw" for k in T.INTENT_KEYWORDS)
    return f"""
    WITH pl AS (SELECT doc_id, {S.strip_ws('patch')} AS p FROM ({patch_src})),
    lst AS (SELECT doc_id, p, string_split_regex(p, {_LB}) AS ls FROM pl),
    ln AS (SELECT doc_id, unnest(ls) AS l, unnest(range(0, len(ls))) AS i FROM lst),
    hd AS (SELECT doc_id, i, {S.strip_ws(f"CASE WHEN regexp_matches(l, {_HDR_B}) THEN regexp_extract(l, {_HDR_B}, 1) ELSE regexp_extract(l, {_HDR}, 1) END")} AS f
           FROM ln WHERE regexp_matches(l, {_HDR})),
    fd AS (SELECT doc_id, f, min(i) AS fi FROM hd WHERE f <> '' GROUP BY doc_id, f),
    fr AS (SELECT doc_id, f, fi, row_number() OVER (PARTITION BY doc_id ORDER BY fi) AS r FROM fd),
    cap AS (SELECT doc_id, fi AS cap_i FROM fr WHERE r = 10),
    files AS (SELECT doc_id, f AS v, fi AS i FROM fr WHERE r <= 10),
    content AS (SELECT ln.doc_id, ln.i, ln.l FROM ln LEFT JOIN cap USING (doc_id)
                WHERE NOT (regexp_matches(ln.l, {_HDR}) AND ln.i <= coalesce(cap.cap_i, 2147483647))),
    addr AS (SELECT doc_id, {S.strip_ws('substr(l, 2)')} AS v, i,
                    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r
             FROM content WHERE starts_with(l, '+') AND NOT starts_with(l, '++++')),
    remr AS (SELECT doc_id, {S.strip_ws('substr(l, 2)')} AS v, i,
                    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r
             FROM content WHERE starts_with(l, '-') AND NOT starts_with(l, '----')),
    added AS (SELECT * FROM addr WHERE r <= 10), removed AS (SELECT * FROM remr WHERE r <= 10),
    allv AS (SELECT doc_id, v FROM files UNION ALL SELECT doc_id, v FROM added UNION ALL SELECT doc_id, v FROM removed),
    kwl AS ({kws}),
    hits AS (SELECT a.doc_id, k.kw FROM allv a, kwl k WHERE contains(lower(a.v), k.kw) GROUP BY a.doc_id, k.kw),
    sec AS (
      SELECT p.doc_id, p.p,
        (SELECT 'FILES: ' || string_agg(v, ' ' ORDER BY i) FROM files f WHERE f.doc_id = p.doc_id) AS s1,
        (SELECT 'ADDED: ' || string_agg(v, ' ; ' ORDER BY i) FROM added a WHERE a.doc_id = p.doc_id) AS s2,
        (SELECT 'REMOVED: ' || string_agg(v, ' ; ' ORDER BY i) FROM removed r WHERE r.doc_id = p.doc_id) AS s3,
        (SELECT 'KEYWORDS: ' || string_agg(kw, ' ' ORDER BY kw) FROM hits h WHERE h.doc_id = p.doc_id) AS s4
      FROM pl p)
    SELECT doc_id, CASE WHEN length(p) = 0 THEN '' ELSE substr(concat_ws(' | ', s1, s2, s3, s4), 1, 1500) END AS patch_feat
    FROM sec
    """


def _oracles() -> dict[str, str]:
    o = {}
    o["clean_text"] = f"SELECT doc_id, {S.clean_text('text')} AS clean FROM documents"
    o["normalize_message"] = _norm_msg_sql()
    o["filter_tokens"] = f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS tokens FROM documents"
    o["normalize_tokens"] = (f"SELECT doc_id, array_to_string(list_filter(list_transform({_TOKENS.replace('length(t) >= 2', 'length(t) >= 1')}, "
                             f"lambda t: {_lemma_case('t')}), lambda t: length(t) >= 2), ' ') "
                             f"AS tokens FROM documents")
    o["parse_llm_label"] = r"""
    WITH src AS (SELECT o_orderkey AS item_id, '{"category": "' || o_orderpriority ||
                 CASE WHEN o_orderkey % 7 = 0 THEN ':extra' ELSE '' END || '"}' AS out FROM orders)
    SELECT item_id, regexp_replace(string_split(out, ':')[2], '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS label
    FROM src WHERE len(string_split(out, ':')) = 2"""
    o["query_pattern"] = f"""
    WITH g AS ({GRID_SQL})
    SELECT query, lower(replace(array_to_string(list_slice(string_split(query, ' '), 1, len(string_split(query, ' ')) - 1), ' '), '"', '')) AS pattern
    FROM g"""
    o["repo_from_url"] = """
    SELECT page_id, CASE WHEN len(string_split(url, '/')) >= 5
           THEN string_split(url, '/')[4] || '/' || string_split(url, '/')[5] END AS repo_full_name FROM pages"""
    o["extract_comments"] = """
    WITH parts AS (SELECT page_id, string_split(html, '<!--') AS ps FROM pages),
    ex AS (SELECT page_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM parts),
    nl AS (SELECT page_id, i, p, len(string_split(p, chr(10))) - 1 AS n FROM ex),
    cum AS (SELECT page_id, i, p, 1 + coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM nl)
    SELECT page_id, CAST(line AS INTEGER) AS line,
           """ + S.strip_ws("'<!--' || split_part(p, '-->', 1) || '-->'") + """ AS comment
    FROM cum WHERE i > 0 AND contains(p, '-->')"""
    # the sources hold no escapes, triple quotes or other strings over several lines, so a line tells
    hash_re = S.lit(HASH_COMMENT_RE)
    o["extract_line_comments"] = f"""
    WITH ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    ex AS (SELECT doc_id, unnest(l) AS line_text, unnest(range(0, len(l))) AS i FROM ls),
    src AS (SELECT doc_id, i, CASE WHEN i % 3 = 2 THEN '# ' || line_text ELSE line_text END AS s FROM ex),
    c AS (SELECT doc_id, CAST(i + 1 AS INTEGER) AS line, regexp_extract(s, {hash_re}, 1) AS comment FROM src)
    SELECT doc_id, line, {S.strip_ws('comment')} AS comment FROM c WHERE comment <> ''"""
    o["patch_features"] = _patch_sql(PATCHES_SQL)
    o["compose_doc_text"] = f"""
    WITH m AS ({_norm_msg_sql()}), f AS ({_patch_sql(PATCHES_SQL)})
    SELECT m.doc_id, CASE WHEN length(f.patch_feat) > 0 THEN m.message || ' [PATCH] ' || f.patch_feat
                          ELSE m.message END AS doc_text
    FROM m JOIN f USING (doc_id)"""
    toks = f"list_filter(list_filter(string_split({S.clean_text('text')}, ' '), lambda t: length(t) >= 2), " \
           f"lambda t: NOT list_contains({_STOPS}, t))"
    o["ngrams"] = S.ngram_rows(toks, "doc_id", "documents", 1, 2)
    return o


ORACLE = _oracles()
