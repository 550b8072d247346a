"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule says when a text is rejected.  Their cost and selectivity are measured on a bounded sample
of the whole table; the rules then run in the order of rejections per second of cost, inside one CASE, so a text
that an early rule rejects never reaches the dear ones.  The order has no influence on the verdict.

Defined cases: null text counts as empty, has no words and fails the base; repeated rows and ties get
equal results; an empty table gives an empty result; other columns, also ones named like the results,
do not enter (the query selects its own columns).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.llm.common import BLANKS, read, text_or_empty

WINDOW = 8
MIN_WORDS = 20
#: About so many rows, drawn by chance, on which costs and rejections are measured; they decide the order of the rules, not a verdict.
SAMPLE_ROWS, SAMPLE_SEED = 1000, 11


@dataclass(frozen=True)
class Rule:
    """``reject`` maps a text's base counts, a struct column that also holds the text as ``t``, to a boolean."""

    name: str
    reject: callable


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    """Characters of the class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def line_counts(text: Column) -> Column:
    """Lines that hold a word, and how many of them equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def window_hashes(words: Column) -> Column:
    """Hash of every run of WINDOW words (of pairs, of pairs of those, and so on), one more of what is
    left for each of the last positions."""
    def doubled(x: Column, k: int) -> Column:
        rest = F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))
        paired = F.zip_with(x, rest, lambda a, b: F.xxhash64(a, b))
        return paired if 2 * k == WINDOW else _let(paired, lambda p: doubled(p, 2 * k))

    return doubled(words, 1)


def repeat_words(words: Column) -> Column:
    """Words inside runs of WINDOW words that occur twice or more in the text (first ones included)."""

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, d: F.get(s, k)["h"].eqNullSafe(F.get(s, k + d)["h"])
            return F.sort_array(F.transform(
                F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1)),
                lambda k: F.get(s, k)["i"]))

        step = lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["e"])).alias("n"), (i + WINDOW).alias("e"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("e"))
        return F.aggregate(_let(by_hash, starts), zero, step, lambda a: a["n"])

    def repeated(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    whole = lambda w: F.slice(window_hashes(w), 1, F.size(w) - (WINDOW - 1))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(whole(words), repeated)).cast("long")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame, text: str, others: list[str]) -> DataFrame:
    """The columns ``others`` and a struct ``__c`` of the text ``t`` and its counts."""
    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        repeat_words(w).alias("n_repeat_words"))

    t = text_or_empty(text)
    step = docs.select(*[F.col(f"`{c}`") for c in others], t.alias("__t"), _let(words_of(t), of_words).alias("__w"),
                       line_counts(t).alias("__l"), count_of(t, "#*$%&|<>").alias("__s"))
    return step.select(*[F.col(f"`{c}`") for c in others], F.struct(
        F.col("__t").alias("t"), "__w.n_words", "__w.word_chars", F.col("__s").alias("n_symbols"),
        F.col("__l.n").alias("n_lines"), F.col("__l.dup").alias("n_dup_lines"), "__w.n_repeat_words").alias("__c"))


#: Rejections, with the texts they are meant for.  Whole-number arithmetic, so SQL gives equal verdicts.
RULES = [
    # tables, markup and noise: more than one symbol to ten words
    Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"]),
    # shouting: most characters of words are capitals
    Rule("capitals", lambda c: 2 * count_of(c["t"], r"\p{Lu}") > c["word_chars"]),
    # exclamations: more than one to five words
    Rule("exclamations", lambda c: 5 * count_of(c["t"], "!") > c["n_words"]),
    # word salad or broken spacing: mean word under 2 or over 15 characters
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])),
    # repeated lines: more than three in ten, and not just one
    Rule("repeated_lines", lambda c: (10 * c["n_dup_lines"] > 3 * c["n_lines"]) & (c["n_dup_lines"] > 1)),
    # numbers and codes: more than half of the characters of words are no letters
    Rule("letters", lambda c: 2 * F.length(F.regexp_replace(c["t"], rf"[\p{{L}}{BLANKS}]+", "")) > c["word_chars"]),
    # the same few words over and over: fewer distinct ones than a quarter of the words and than the root of 12.5 times
    # their number (a vocabulary grows about with the root of a text; the bounds meet at 200 words)
    Rule("distinct_words", lambda c: _let(F.size(F.array_distinct(words_of(c["t"]))).cast("long"),
         lambda d: (4 * d < c["n_words"]) & (2 * d * d < 25 * c["n_words"]))),
]


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS,
                text: str = "text") -> list[Rule]:
    """``rules`` by rejections per second of cost, as measured on about ``sample_rows`` rows drawn from the whole table
    (each with the same chance)."""
    every = docs.count()
    drawn = docs.select(text).sample(min(1.0, sample_rows / max(every, 1)), seed=SAMPLE_SEED)
    sample = with_counts(drawn, text, []).persist()
    try:
        rows = sample.count()

        def timed(reject) -> tuple[float, int]:
            began = time.perf_counter()
            hits = sample.agg(F.count(F.when(reject(F.col("__c")), 1))).first()[0]
            return time.perf_counter() - began, hits

        idle = min(timed(lambda c: c["t"].isNull())[0] for _ in range(2))
        rank = []
        for i, rule in enumerate(rules):
            (a, hits), (b, _) = timed(rule.reject), timed(rule.reject)
            rank.append(((hits + 0.5) / (rows + 1) / max(min(a, b) - idle, 1e-3), i))
    finally:
        sample.unpersist()
    return [rules[i] for _, i in sorted(rank, key=lambda x: (-x[0], x[1]))]


def rejected_by(counts: Column, ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    verdict = F
    for rule in ordered:
        verdict = verdict.when(rule.reject(counts), F.lit(rule.name))
    return F.lit(None).cast("string") if verdict is F else verdict


def quality_rules(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS,
                  text: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept`` (columns of these names are replaced).

    ``kept`` is false if the base or any rule fails.
    """
    ordered = order_rules(docs, rules, sample_rows, text)
    others = [c for c in docs.columns if c not in [*COUNTS, "base_failed", "kept"]]
    c = F.col("__c")
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    kept = F.when(failed, F.lit(False)).otherwise(rejected_by(c, ordered).isNull())
    return with_counts(docs, text, others).select(
        *[F.col(f"`{x}`") for x in others], *[c[x].alias(x) for x in COUNTS], failed.alias("base_failed"),
        kept.alias("kept"))


def q_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                      "n_repeat_words", "base_failed", "kept")


def verdict_sql(source: str = "documents") -> str:
    """CTEs ending in ``judged``: every row of ``source`` with the counts and both verdicts."""
    return f"""
    base AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {source}),
    w AS (SELECT rid, regexp_extract_all(t, '[^{BLANKS}]+') AS words FROM base),
    win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g
            FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
    rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY rid),
    l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{BLANKS}]')) AS lines FROM base),
    counted AS (
        SELECT base.*, len(words) AS n_words, coalesce(cov.n, 0) AS n_repeat_words, words, lines,
               length(array_to_string(words, '')) AS word_chars, len(lines) AS n_lines,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines
        FROM base JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN cov USING (rid)),
    judged AS (
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words
                    OR 10 * n_symbols > n_words
                    OR 2 * length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) > word_chars
                    OR 5 * length(regexp_replace(t, '[^!]', '', 'g')) > n_words
                    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR (10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 1)
                    OR 2 * length(regexp_replace(t, '[\\p{{L}}{BLANKS}]', '', 'g')) > word_chars
                    OR (4 * len(list_distinct(words)) < n_words
                        AND 2 * len(list_distinct(words)) * len(list_distinct(words)) < 25 * n_words)) AS kept
        FROM counted)"""


QUERIES = {"op1_quality_rules": q_quality_rules}
ORACLE = {"op1_quality_rules": f"""
    WITH {verdict_sql()}
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept
    FROM judged"""}
