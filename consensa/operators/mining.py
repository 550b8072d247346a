"""Mining joins and roll-ups: annotator intersection, phrase grid, hit counts, comment
matches, tracked commits, repo metrics and roll-ups, comment lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consensa.operators.phrases import phrase_matches


def join_annotators(votes: DataFrame, annotators: list[str] | None = None) -> DataFrame:
    """Keep the items labelled by every annotator (intersection of item keys) as long votes.

    One aggregation by item (partial counts map-side) and a left-semi join back; with AQE
    a hot item is split by the skew-join handling instead of landing in one task.
    """
    v = votes.select("item_id", "annotator", "label")
    if annotators is not None:
        v = v.filter(F.col("annotator").isin(list(annotators)))
        n = F.lit(len(set(annotators)))
        full = v.groupBy("item_id").agg(F.count_distinct("annotator").alias("n")).filter(F.col("n") == n)
    else:
        n_all = v.agg(F.count_distinct("annotator")).first()[0]   # one number
        full = v.groupBy("item_id").agg(F.count_distinct("annotator").alias("n")).filter(F.col("n") == n_all)
    from consensa.operators.skew import skew_join
    return skew_join(v, full.select("item_id"), "item_id", "left_semi")


def phrase_grid(languages: DataFrame, phrase_a: list[str], phrase_b: list[str],
                phrase_c: list[str], lang_col: str = "language") -> DataFrame:
    """Search queries ``"A B" language:L`` and ``"B C A" language:L`` for every language.

    The phrase lists are parameters (small, fixed); they are expanded per language row with a
    generator, so the only distributed input is the language table.
    """
    ab = [(f"{a} {b}") for a in phrase_a for b in phrase_b]
    bca = [(f"{b} {c} {a}") for b in phrase_b for c in phrase_c for a in phrase_a]
    phrases = F.array(*[F.lit(p) for p in ab + bca])
    g = languages.select(F.col(lang_col).alias("language"), F.explode(phrases).alias("phrase"))
    return g.select(F.concat(F.lit('"'), F.col("phrase"), F.lit('" language:'), F.col("language")).alias("query"),
                    "phrase", "language")


def query_hit_pairs(docs: DataFrame, grid: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every (document, query) hit: the document has the query's language and its
    lower-cased text contains the phrase.  Returns the document's columns plus ``query``.

    The distinct phrases are matched in one pass (:mod:`consensa.operators.phrases`); what they
    hit joins the grid by phrase and language."""
    found = phrase_matches(docs, F.lower(F.col(text_col)), grid.select("phrase"), "_phrase")
    queries = grid.select("query", F.col("phrase").alias("_phrase"), F.col("language").alias("_language")).distinct()
    hit = found.join(queries, (F.col("_language") == F.col(lang_col)) & found["_phrase"].eqNullSafe(queries["_phrase"]))
    return hit.select(*[found[c] for c in docs.columns], "query")


def query_hits(docs: DataFrame, grid: DataFrame, min_hits: int = 1, text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """Hits of every search query over a corpus: documents of the query's language whose
    lower-cased text contains the phrase.  ``(query, hits)``, queries under ``min_hits``
    dropped (0 keeps every query).

    Zero-hit queries come from a union with the grid, not from an outer join.
    """
    hits = query_hit_pairs(docs.select(text_col, lang_col), grid, text_col, lang_col) \
        .select("query", F.lit(1).cast("long").alias("n"))
    zeros = grid.select("query", F.lit(0).cast("long").alias("n"))
    out = hits.unionByName(zeros).groupBy("query").agg(F.sum("n").alias("hits"))
    return out.filter(F.col("hits") >= min_hits) if min_hits > 0 else out


def match_comments(comments: DataFrame, patterns: list[str] | DataFrame, text_col: str = "comment") -> DataFrame:
    """Every (comment, pattern) pair where the lower-cased comment contains the pattern, for patterns
    of any number (a list, or the first column of a table)."""
    return phrase_matches(comments, F.lower(F.col(text_col)), patterns, "pattern")


def tracked_commits(commit_files: DataFrame, tracked: DataFrame, branch_order: list[str] | None = None) -> DataFrame:
    """Commit-file rows of tracked files only, one row per (file, sha): the first branch in
    ``branch_order`` (default: alphabetical) wins, and the commit's other columns (message,
    author, date, patch, url) come with it, the least ones if a branch has several.  Semi join +
    one aggregation."""
    from consensa.operators.skew import skew_join
    # a file touched by a large share of all commits is split over salt buckets
    kept = skew_join(commit_files, tracked.select("file").distinct(), "file", "left_semi")
    rank = F.lit(0)
    if branch_order:
        rank = F.array_position(F.array(*[F.lit(b) for b in branch_order]), F.col("branch"))
        rank = F.when(rank == 0, F.lit(1 << 30)).otherwise(rank)
    payload = [c for c in commit_files.columns if c not in ("file", "sha", "branch")]
    first = kept.groupBy("file", "sha").agg(F.min(F.struct(rank.alias("_rank"), "branch", *payload)).alias("m"))
    return first.select("file", "sha", *[F.col(f"m.{c}").alias(c) for c in ["branch", *payload]])


def repo_rollup(hits: DataFrame) -> DataFrame:
    """Hits, distinct files and distinct queries per repo (keyed by full name), busiest first:
    ``(repo_full_name, total_count, n_files, queries, query_count)``."""
    g = hits.groupBy("repo_full_name").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_distinct("file").alias("n_files"),
        F.array_sort(F.collect_set("query")).alias("_q"))
    return g.select("repo_full_name", "total_count", "n_files", F.array_join("_q", ",").alias("queries"),
                    F.size("_q").cast("long").alias("query_count")).orderBy(F.col("total_count").desc(), "repo_full_name")


def repo_metrics(repos: DataFrame, metrics: DataFrame, defaults: dict) -> DataFrame:
    """Attach metrics to repos; repos without metrics get ``defaults`` and
    ``has_metrics = false``."""
    m = metrics.withColumn("_has", F.lit(True))
    j = repos.join(m, "repo_full_name", "left")
    cols = [c for c in repos.columns]
    cols += [F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()]
    cols.append(F.coalesce(F.col("_has"), F.lit(False)).alias("has_metrics"))
    return j.select(*cols)


def comment_lineage(commits: DataFrame) -> DataFrame:
    """Introducing and first-changing commit per comment.

    ``commits(comment_id, ts, sha, state)``: the introduction is the earliest commit by
    (ts, sha); the first change is the earliest later commit whose ``state`` differs from
    the introduction's.  Two aggregations with map-side partial mins and one equi join; a
    comment with a huge history is split by AQE's skew-join handling.
    """
    from consensa.operators.skew import skew_join
    key = F.struct("ts", "sha")
    intro = commits.groupBy("comment_id").agg(F.min(F.struct("ts", "sha", "state")).alias("i"))
    # a comment with a huge history is split over salt buckets before meeting its intro row
    later = (skew_join(commits, intro, "comment_id")
             .filter((key > F.struct(F.col("i.ts"), F.col("i.sha"))) & (F.col("state") != F.col("i.state")))
             .groupBy("comment_id").agg(F.min(key).alias("c")))
    return (intro.join(later, "comment_id", "left")
            .select("comment_id", F.col("i.sha").alias("intro_sha"), F.col("i.ts").alias("intro_ts"),
                    F.col("c.sha").alias("change_sha"), F.col("c.ts").alias("change_ts")))
