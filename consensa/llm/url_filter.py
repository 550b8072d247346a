"""URL filter: explicit rules first, then the ratio of two character language models.

Two smoothed variable-order Markov models, one of the URLs that the rules accept and one of those they
reject, are counted over all URLs with a rule's verdict.  The probability of a character after up to
ORDER others is interpolated (Witten-Bell) down to the shorter contexts and at last to equal chances.  A
URL's score is the mean over its characters of the difference of the two log-probabilities; the limit
below which a URL is blocked is calibrated on every fifth labelled URL (by hash), which the models used for
that have not seen.  Counts, models and scores are tables: nothing but the histogram of the calibration
(two thousand rows at most) comes to the driver.

Defined cases: a null URL counts as empty, has an empty host and path and no rule; without both kinds of
labelled URLs the limit is 0 and equal scores are allowed; repeated URLs count as often as they occur and
get one verdict; an empty table gives an empty result; other columns are kept (results' names replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.llm.common import read, written

ORDER = 4
#: Chances of a character about which nothing is known.
ALPHABET = 256
CALIBRATION = 5
BINS = 100  # of the calibration, for each unit of score
MOST = 10.0  # scores beyond +-MOST fall into the histogram's last bins
#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name = verdict = F
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return name, verdict


def gram_rows(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of a URL and one for its end: with the ORDER characters before it."""
    padded = F.concat(F.lit("\x02" * ORDER), F.col("url"), F.lit("\x03"))
    each = F.transform(F.sequence(F.lit(1), F.length("url") + 1), lambda i: padded.substr(i, F.lit(ORDER + 1)))
    return urls.select(*keep, F.explode(each).alias("gram"))


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of which no side is sent to the driver to be broadcast.  Spark takes a written table for as large as its compressed
    file and exploded rows for as large as what they come from, so it would broadcast tables many times over its limit."""
    return left.join(right.hint("merge"), on, how)


def log_ratios(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """Log of the ratio of both models' probabilities for each gram of ``wanted``.

    ``grams``: gram, accepted, rejected (counts) of the training URLs."""
    size = F.sequence(F.lit(1), F.lit(ORDER + 1))
    suffixes = lambda c: F.transform(size, lambda k: F.struct(
        k.alias("k"), F.substr(c, F.lit(ORDER + 2) - k).alias("s")))
    counts = (grams.select(F.inline(suffixes(F.col("gram"))), "accepted", "rejected")
              .groupBy("k", "s").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")))
    counts = written(counts, "url-counts")
    context = F.substr(F.col("s"), F.lit(1), F.col("k") - 1)
    contexts = counts.groupBy("k", context.alias("x")).agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"),
        F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
    # counts and contexts are joined to the distinct suffixes, of which the short ones are few, and these to the grams
    parts = wanted.select("gram", F.inline(suffixes(F.col("gram"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    found = joined(joined(parts.select("k", "s").distinct().withColumn("x", context), counts, ["k", "s"], "left"), contexts, ["k", "x"],
                   "left").select("k", "s", *[zero(c) for c in ("a", "r", "na", "nr", "ta", "tr")])
    listed = joined(parts, found, ["k", "s"]).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(
        "k", "a", "r", "na", "nr", "ta", "tr"))).alias("l"))

    def mixed(count: str, total: str, types: str) -> Column:
        return F.aggregate("l", F.lit(1.0 / ALPHABET), lambda p, x: F.when(x[total] == 0, p).otherwise(
            (x[count] + x[types] * p) / (x[total] + x[types])))

    return listed.select("gram", (F.log(mixed("a", "na", "ta")) - F.log(mixed("r", "nr", "tr"))).alias("ratio"))


def scores(urls: DataFrame, train: Column, judged: Column) -> DataFrame:
    """url and score of the rows of ``urls`` (url, accepted, rejected) that ``judged`` holds for, by models of
    those that ``train`` holds for."""
    counted = (gram_rows(urls.where(train), "accepted", "rejected").groupBy("gram")
               .agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    rows = gram_rows(urls.where(judged), "url")
    ratio = log_ratios(counted, rows.select("gram").distinct())
    return joined(rows, ratio, "gram").groupBy("url").agg(F.round(F.avg("ratio"), 6).alias("score"))


def limit(scored: DataFrame) -> float:
    """The score that parts accepted from rejected URLs best (mean of both recalls)."""
    bin_ = F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("score"))) * BINS).cast("int")
    rows = (scored.groupBy(bin_.alias("b")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
            .orderBy("b").collect())
    accepted, rejected = sum(x.a for x in rows), sum(x.r for x in rows)
    if not accepted or not rejected:
        return 0.0
    best, below_a, below_r = [], 0, 0
    for x in rows:
        best.append(((accepted - below_a) / accepted + below_r / rejected, -abs(x.b), x.b))
        below_a, below_r = below_a + x.a, below_r + x.r
    return max(best)[2] / BINS


def judge(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and the models' score (null where a rule decides)."""
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    ruled = pages.select(*[F.col(f"`{c}`") for c in others], text.alias("__url"), host_of(text).alias("host"),
                         path_of(text).alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = ruled.select("*", name.alias("rule"), verdict.alias("__ruled"))
    urls = written(ruled.groupBy(F.col("__url").alias("url")).agg(
        F.count_if(F.col("__ruled") == "allow").alias("accepted"),
        F.count_if(F.col("__ruled") == "block").alias("rejected")), "urls")
    labelled = F.col("accepted") + F.col("rejected") > 0
    held_out = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0
    trial = scores(urls, labelled & ~held_out, labelled & held_out)
    cut = limit(joined(urls, trial, "url"))
    final = scores(urls, labelled, ~labelled)
    out = joined(ruled, final.withColumnRenamed("url", "__url"), "__url", "left")
    by_model = F.when(F.col("score") < cut, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*[F.col(f"`{c}`") for c in others], "host", "path", "rule",
                      F.coalesce("__ruled", by_model).alias("verdict"), "score")


def q_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op4_url_filter": q_url_filter}
ORACLE: dict[str, str] = {}
