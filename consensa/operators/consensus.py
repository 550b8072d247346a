"""Vote consensus: priors, majority vote, hard labels and Dawid-Skene EM.

Data model
----------
* votes:  long table ``(item_id, annotator, label)``; missing and repeated votes allowed.
* classes: an explicit, ordered Python list (order breaks ties).  Votes whose label is
  not a class are ignored everywhere.
* posterior: ``(item_id, post array<double>)`` with one entry per class, in class order.
  :func:`expand_posterior` turns it into ``p_<class>`` columns.

Scale design
------------
Items that carry the same multiset of (annotator, label) votes (and the same gold label)
have identical posteriors, so EM runs on the *pattern histogram*: one row per distinct
pattern with its item count as weight.  Building it takes three aggregations with map-side
partial aggregation (votes -> (item, annotator, label) counts -> item signature -> pattern),
so a hot item or annotator never lands in a single task un-aggregated.  Each EM iteration is
then ONE Spark job over the (checkpointed, partitioned) pattern table: every task scores its
patterns with numpy and sums the M-step statistics and the log-likelihood, so only
``A*K*K + K + 1`` numbers of each task go to the driver per iteration.  Item posteriors are produced once at the end by joining items
to their pattern.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.session import cut_lineage

# Fixed values shared with the reference semantics.
FLOOR = 1e-12          # probabilities are floored before taking logs
ABSTAIN = "ABSTAIN"    # hard label emitted under the abstain threshold
PATTERNS_PER_PARTITION = 200_000  # EM pattern-table partition size (one task per slice)


# ---------------------------------------------------------------------------
# Helpers
# ---------------------------------------------------------------------------
MAX_CLASSES = 10_000     # classes and annotators are model dimensions, collected with a bound
MAX_ANNOTATORS = 100_000


def _bounded_distinct(df: DataFrame, col: str, limit: int) -> list[str]:
    rows = df.select(col).distinct().filter(F.col(col).isNotNull()).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct values in {col!r}: not a label set")
    return sorted(r[0] for r in rows)


def class_list(votes: DataFrame, label_col: str = "label") -> list[str]:
    """Default classes: all distinct vote labels, sorted (a bounded model dimension)."""
    return _bounded_distinct(votes, label_col, MAX_CLASSES)


def annotator_list(votes: DataFrame) -> list[str]:
    return _bounded_distinct(votes, "annotator", MAX_ANNOTATORS)


def _class_index(classes: list[str]) -> Column:
    """Column expression mapping ``label`` to its class index (null when not a class)."""
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    return m[F.col("label")]


def _in_classes(votes: DataFrame, classes: list[str]) -> DataFrame:
    return votes.filter(F.col("label").isin(list(classes)))


def expand_posterior(df: DataFrame, classes: list[str], post_col: str = "post",
                     digits: int | None = 6) -> DataFrame:
    """Replace the ``post`` array by one ``p_<class>`` column per class."""
    cols = [c for c in df.columns if c != post_col]
    exprs = []
    for k, c in enumerate(classes):
        e = F.col(post_col)[k]
        exprs.append((F.round(e, digits) if digits is not None else e).alias(f"p_{c}"))
    return df.select(*cols, *exprs)


# ---------------------------------------------------------------------------
# 31 priors, 32 majority vote, 33 hard label
# ---------------------------------------------------------------------------
def vote_priors(votes: DataFrame, classes: list[str], mix_uniform: float = 0.0,
                label_col: str = "label") -> DataFrame:
    """Add-one smoothed class shares of all in-class votes: ``(label, ord, n_votes, prior)``.

    ``(votes(c) + 1) / (votes + K)``; ``1/K`` when there are no votes; optionally mixed with
    the uniform distribution.  One partial aggregation to K counts (a model dimension, read
    with a bound); the K-row result is built from them.
    """
    K = len(classes)
    spark = votes.sparkSession
    counts = (votes.select(F.col(label_col).alias("label"))
              .filter(F.col("label").isin(list(classes)))
              .groupBy("label").agg(F.count(F.lit(1)).alias("n_votes")))
    got = {r["label"]: int(r["n_votes"]) for r in counts.limit(K + 1).collect()}
    total = sum(got.values())
    rows = []
    for i, c in enumerate(classes):
        p = (got.get(c, 0) + 1.0) / (total + K) if total > 0 else 1.0 / K
        if mix_uniform > 0:
            p = (1 - mix_uniform) * p + mix_uniform / K
        rows.append((c, i, got.get(c, 0), p))
    return spark.createDataFrame(rows, "label string, ord int, n_votes bigint, prior double")


def priors_from_votes(votes: DataFrame, classes: list[str], mix_uniform: float = 0.0) -> np.ndarray:
    """Driver copy of :func:`vote_priors` (K numbers)."""
    rows = {r["label"]: r["prior"] for r in vote_priors(votes, classes, mix_uniform).collect()}
    return np.array([rows[c] for c in classes], dtype=float)


def priors_from_patterns(vp: "VotePatterns", mix_uniform: float = 0.0) -> np.ndarray:
    """Smoothed vote priors from the (small, cached) pattern histogram: the same counts as
    :func:`priors_from_votes` over the patterns' items, without re-reading the votes."""
    K = len(vp.classes)
    rows = (vp.patterns.select("w", F.explode("votes").alias("v"))
            .groupBy(F.col("v.l").alias("l")).agg(F.sum(F.col("w") * F.col("v.cnt")).alias("n")).collect())
    cnt = np.zeros(K)
    for r in rows:
        cnt[r["l"]] = r["n"]
    p = (cnt + 1.0) / (cnt.sum() + K) if cnt.sum() > 0 else np.full(K, 1.0 / K)
    if mix_uniform > 0:
        p = (1 - mix_uniform) * p + mix_uniform / K
    return p


def priors_from_gold(gold: DataFrame, classes: list[str], mix_uniform: float = 0.0) -> np.ndarray:
    """Semi-supervised start: add-one shares of the gold labels (all gold rows count in
    the total, also labels outside the classes)."""
    K = len(classes)
    r = gold.agg(F.count(F.lit(1)).alias("total"),
                 *[F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(f"n{k}") for k, c in enumerate(classes)]).first()
    cnt = {c: int(r[f"n{k}"] or 0) for k, c in enumerate(classes)}
    total = int(r["total"] or 0)  # every gold row counts in the total, in-class or not
    if total > 0:
        p = np.array([(cnt.get(c, 0) + 1.0) / (total + K) for c in classes])
    else:
        p = np.full(K, 1.0 / K)
    if mix_uniform > 0:
        p = (1 - mix_uniform) * p + mix_uniform / K
    return p


def majority_vote(votes: DataFrame, classes: list[str], priors: np.ndarray | None = None,
                  mode: str = "mv+priors", items: DataFrame | None = None) -> DataFrame:
    """Per-item vote shares as ``(item_id, post)``.

    ``mode``: ``uniform`` (1/K for items with votes), ``mv`` (vote share) or ``mv+priors``
    (share x floored prior, renormalised; 1 when the sum is 0).  Items in ``items`` without
    any in-class vote get the priors.  One aggregation by item with map-side combine.
    """
    K = len(classes)
    v = _in_classes(votes, classes)
    counts = v.groupBy("item_id").agg(
        *[F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(f"n{k}") for k, c in enumerate(classes)])
    if priors is None:
        # one pass over the votes: per-item counts are materialised and the priors summed
        # from them (K numbers), instead of reading the votes a second time
        counts = cut_lineage(counts)
        tot = counts.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(K)]).first()
        n = np.array([float(tot[f"n{k}"] or 0) for k in range(K)])
        priors = (n + 1.0) / (n.sum() + K) if n.sum() > 0 else np.full(K, 1.0 / K)
    tot = sum((F.col(f"n{k}") for k in range(K)), F.lit(0))
    if mode == "uniform":
        post = F.array(*[F.lit(1.0 / K) for _ in range(K)])
    else:
        if mode == "mv+priors":
            scr = [(F.col(f"n{k}") / tot) * F.lit(max(float(priors[k]), FLOOR)) for k in range(K)]
        elif mode == "mv":
            scr = [F.col(f"n{k}") / tot for k in range(K)]
        else:
            raise ValueError(f"unknown init mode {mode!r}")
        s = sum(scr[1:], scr[0])
        denom = F.when(s == 0, F.lit(1.0)).otherwise(s)
        post = F.array(*[x / denom for x in scr])
    out = counts.select("item_id", post.alias("post"))
    if items is not None:
        prior_arr = F.array(*[F.lit(float(p)) for p in priors])
        out = (items.select("item_id").join(out, "item_id", "left")
               .select("item_id", F.coalesce("post", prior_arr).alias("post")))
    return out


def hard_label(posterior: DataFrame, classes: list[str], abstain_thresh: float | None = None,
               post_col: str = "post") -> DataFrame:
    """Arg-max class (ties -> earlier class), its probability and the top-2 margin.

    Row-local on the posterior array: no shuffle.
    """
    K = len(classes)
    post = F.col(post_col)
    conf = F.array_max(post)
    idx = F.array_position(post, conf)  # first position of the max = earliest class on ties
    label = F.element_at(F.array(*[F.lit(c) for c in classes]), idx.cast("int"))
    second = F.sort_array(post, asc=False)[1] if K > 1 else F.lit(0.0)
    margin = conf - second
    if abstain_thresh is not None:
        label = F.when(conf < abstain_thresh, F.lit(ABSTAIN)).otherwise(label)
    keep = [c for c in posterior.columns if c != post_col]
    return posterior.select(*keep, label.alias("pred_label"), conf.alias("confidence"),
                            margin.alias("top2_margin"), post)


# ---------------------------------------------------------------------------
# Model
# ---------------------------------------------------------------------------
@dataclass
class DSModel:
    classes: list[str]
    annotators: list[str]
    priors: np.ndarray                      # (K,)
    confusions: np.ndarray                  # (A, K true, K observed)
    ll_history: list[float] = field(default_factory=list)

    @property
    def K(self) -> int:
        return len(self.classes)

    def confusion_rows(self) -> list[tuple]:
        return [(a, ct, co, float(self.confusions[i, j, k]))
                for i, a in enumerate(self.annotators)
                for j, ct in enumerate(self.classes)
                for k, co in enumerate(self.classes)]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Model as a long table ``(kind, annotator, true_label, obs_label, p)``."""
        rows = [("prior", None, c, None, float(p)) for c, p in zip(self.classes, self.priors)]
        rows += [("confusion",) + r for r in self.confusion_rows()]
        return spark.createDataFrame(
            rows, "kind string, annotator string, true_label string, obs_label string, p double")


def diagonal_start(classes: list[str], annotators: list[str], priors: np.ndarray,
                   diagonal_bias: float = 0.6) -> DSModel:
    K, A = len(classes), len(annotators)
    off = (1.0 - diagonal_bias) / max(K - 1, 1)
    conf = np.full((A, K, K), off)
    for j in range(K):
        conf[:, j, j] = diagonal_bias
    return DSModel(list(classes), list(annotators), np.asarray(priors, float), conf)


# ---------------------------------------------------------------------------
# Vote patterns
# ---------------------------------------------------------------------------
@dataclass
class VotePatterns:
    """``patterns``: (pid, w, gold_idx, votes array<struct<a int, l int, cnt long>>);
    ``item_pid``: (item_id, pid).  Both checkpointed."""
    patterns: DataFrame
    item_pid: DataFrame
    classes: list[str]
    annotators: list[str]
    n_patterns: int = 0


def _pattern_join(items: DataFrame, pats: DataFrame, key: str) -> DataFrame:
    """Items to their pattern.  A pattern may hold a large share of all items: the adaptive plan broadcasts
    the patterns if their bytes allow it, and else splits such a key."""
    return items.join(pats, key)


def build_patterns(votes: DataFrame, classes: list[str], annotators: list[str] | None = None,
                   items: DataFrame | None = None, gold: DataFrame | None = None) -> VotePatterns:
    """Group items by their vote multiset (+ gold label)."""
    spark = votes.sparkSession
    v = _in_classes(votes.select("item_id", "annotator", "label"), classes)
    if annotators is None:
        annotators = annotator_list(v)
    amap = F.create_map(*[x for i, a in enumerate(annotators) for x in (F.lit(a), F.lit(i))])
    counted = (v.groupBy("item_id", "annotator", "label").agg(F.count(F.lit(1)).alias("cnt"))
               .select("item_id", F.struct(amap[F.col("annotator")].alias("a"),
                                           _class_index(classes).cast("int").alias("l"),
                                           F.col("cnt")).alias("v")))
    sig = counted.groupBy("item_id").agg(F.sort_array(F.collect_list("v")).alias("votes"))
    if items is None:
        item_keys = votes.select("item_id").distinct()
    else:
        item_keys = items.select("item_id").distinct()
    sig = item_keys.join(sig, "item_id", "left")
    if gold is not None:
        gidx = F.coalesce(_class_index(classes).cast("int"), F.lit(-2))  # -2: gold outside classes
        g = gold.select("item_id", gidx.alias("gold_idx"))
        sig = sig.join(g, "item_id", "left")
    else:
        sig = sig.withColumn("gold_idx", F.lit(None).cast("int"))
    sig = sig.withColumn("votes", F.coalesce("votes", F.array().cast(
        "array<struct<a:int,l:int,cnt:bigint>>")))
    sig = cut_lineage(sig)
    # training rejects annotators outside the list (checked on the materialised signatures,
    # so the votes are read only once)
    if sig.filter(F.exists("votes", lambda x: x["a"].isNull())).limit(1).count():
        raise ValueError("a vote comes from an annotator that is not in the annotator list")
    raw = cut_lineage(sig.groupBy("votes", "gold_idx").agg(F.count(F.lit(1)).alias("w")))
    n_pats = raw.count()
    # as many slices as there are task slots, more if one would hold over PATTERNS_PER_PARTITION
    n_parts = max(spark.sparkContext.defaultParallelism, -(-n_pats // PATTERNS_PER_PARTITION))
    pats = raw.repartition(n_parts, "votes", "gold_idx").withColumn("pid", F.monotonically_increasing_id())
    pats = cut_lineage(pats).cache()
    # items -> pattern id
    pkey = F.xxhash64(F.col("votes"), F.coalesce(F.col("gold_idx"), F.lit(-99)))
    left = sig.select("item_id", "votes", "gold_idx", pkey.alias("_pk"))
    right = pats.select(pkey.alias("_pk"), F.col("votes").alias("_pv"), F.col("gold_idx").alias("_pg"), "pid")
    joined = _pattern_join(left, right, "_pk")
    # consumed once at the end; both inputs are checkpointed, so no materialisation here
    item_pid = (joined.filter((F.col("votes") == F.col("_pv")) & F.col("gold_idx").eqNullSafe(F.col("_pg")))
                .select("item_id", "pid"))
    return VotePatterns(pats.select("pid", "w", "gold_idx", "votes"), item_pid, list(classes),
                        list(annotators), n_pats)


# ---------------------------------------------------------------------------
# 47 E-step, 48 M-step, 49 log-likelihood on patterns
# ---------------------------------------------------------------------------
def _model_array(model: DSModel) -> list[float]:
    """All model numbers in one flat list: ``K`` log priors, ``K`` raw priors,
    ``ln(sum priors)``, then for every (annotator a, observed label l) cell the ``K`` log
    confusions over the true classes (block start ``2K + 1 + (a*K + l)*K``).  Passed to Spark
    as ONE array literal so that the plan has the same shape in every EM iteration."""
    K, A = model.K, len(model.annotators)
    vals = [math.log(max(float(p), FLOOR)) for p in model.priors]
    vals += [float(p) for p in model.priors]
    tot = float(np.sum(model.priors))
    vals.append(math.log(tot) if tot > 0 else float("-inf"))
    for a in range(A):
        for l in range(K):
            vals += [math.log(max(float(model.confusions[a, c, l]), FLOOR)) for c in range(K)]
    return vals


def _score_step(marr: Column, K: int):
    def step(acc, v):
        block = F.slice(marr, (v["a"] * K + v["l"]) * K + (2 * K + 2), K)
        return F.zip_with(acc, block, lambda x, y: x + v["cnt"] * y)
    return step


def with_posterior(df: DataFrame, model: DSModel, semi: bool = False, infer: bool = False) -> DataFrame:
    """Add ``post`` (posterior array) and ``ll`` (log-likelihood contribution) to rows with
    ``votes`` (and ``gold_idx`` when ``semi``).

    The class scores ``ln floor(prior_c) + sum cnt * ln floor(conf[a, c, l])`` are ONE
    array-valued fold over the votes (small plan, computed once per row); the softmax and
    log-sum-exp read that array."""
    K = model.K
    marr = F.lit(_model_array(model))
    scored = df.select("*", F.aggregate("votes", F.slice(marr, 1, K), _score_step(marr, K)).alias("_s"))
    scored = scored.select("*", F.array_max("_s").alias("_m"))
    scored = scored.select("*", F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_m"))).alias("_z"))
    soft = F.transform("_s", lambda x: F.exp(x - F.col("_m")) / F.col("_z"))
    has_votes = F.size("votes") > 0
    if infer:
        post = soft  # inference: no votes -> softmax of the floored log priors
    else:
        post = F.when(has_votes, soft).otherwise(F.slice(marr, K + 1, K))
    if semi:
        g = F.col("gold_idx")
        onehot = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: F.when(k == g, 1.0).otherwise(0.0))
        post = F.when(g.isNotNull(), onehot).otherwise(post)
    ll = F.when(has_votes, F.col("_m") + F.log("_z")).otherwise(F.element_at(marr, 2 * K + 1))
    return scored.select(*df.columns, post.alias("post"), ll.alias("ll"))


def _em_statistics(pats: DataFrame, model: DSModel, semi: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """One Spark job: log-likelihood under ``model`` and M-step sufficient statistics of
    the E-step posterior under ``model``.

    Every task scores its patterns with numpy and returns one row of sums (A*K*K + K + 1
    numbers).  The model travels with the function, so the plan does not grow with it and
    needs no new code in each iteration."""
    K, A = model.K, len(model.annotators)
    priors = np.asarray(model.priors, dtype=float)
    floor = FLOOR
    log_prior = np.log(np.maximum(priors, floor))
    log_conf = np.log(np.maximum(np.asarray(model.confusions, dtype=float), floor)).reshape(A, K, K)
    prior_total = float(priors.sum())
    no_votes_ll = math.log(prior_total) if prior_total > 0 else float("-inf")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        ll, prior_sum, conf_sum = 0.0, np.zeros(K), np.zeros((A * K, K))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            vote_a, vote_l, cnt = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            row = np.repeat(np.arange(n), size)
            score = np.empty((n, K))
            for k in range(K):
                score[:, k] = log_prior[k] + np.bincount(row, weights=cnt * log_conf[vote_a, k, vote_l], minlength=n)
            top = score.max(axis=1)
            e = np.exp(score - top[:, None])
            z = e.sum(axis=1)
            post = e / z[:, None]
            post[size == 0] = priors
            if semi:
                gold = batch.column(2).to_pandas().to_numpy(dtype=float)
                known = ~np.isnan(gold)
                post[known] = 0.0
                inside = known & (gold >= 0)
                post[np.flatnonzero(inside), gold[inside].astype(int)] = 1.0
            ll += float((w * np.where(size > 0, top + np.log(z), no_votes_ll)).sum())
            prior_sum += w @ post
            cell = vote_a * K + vote_l
            for k in range(K):
                conf_sum[:, k] += np.bincount(cell, weights=w[row] * cnt * post[row, k], minlength=A * K)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[ll], prior_sum, conf_sum.ravel()]).tobytes()], pa.binary())],
                                         names=["sums"])

    total = np.zeros(1 + K + A * K * K)
    for r in pats.select("w", "votes", "gold_idx").mapInArrow(run, "sums binary").collect():
        total += np.frombuffer(r["sums"])
    conf = total[1 + K:].reshape(A, K, K).transpose(0, 2, 1)  # (annotator, observed, true) -> (annotator, true, observed)
    return float(total[0]), total[1:1 + K].copy(), conf.copy()


def m_step(model: DSModel, prior_sum: np.ndarray, conf_sum: np.ndarray, laplace: float,
           mix_uniform: float) -> DSModel:
    """Driver-side normalisation of the A*K*K sufficient statistics."""
    K = model.K
    tot = prior_sum.sum()
    pri = prior_sum / tot if tot > 0 else prior_sum.copy()
    if mix_uniform > 0:
        pri = (1 - mix_uniform) * pri + mix_uniform / K
    conf = conf_sum + laplace
    rs = conf.sum(axis=2, keepdims=True)
    conf = conf / np.maximum(rs, FLOOR)
    return DSModel(model.classes, model.annotators, pri, conf, list(model.ll_history))


def pattern_posterior_frame(vp: VotePatterns, model: DSModel, semi: bool = False,
                            infer: bool = False) -> DataFrame:
    return with_posterior(vp.patterns, model, semi=semi, infer=infer).select("pid", "post")


def item_posterior(vp: VotePatterns, model: DSModel, semi: bool = False, infer: bool = False) -> DataFrame:
    """Expand a pattern posterior to items: ``(item_id, post)``."""
    pp = pattern_posterior_frame(vp, model, semi=semi, infer=infer)
    return _pattern_join(vp.item_pid, pp, "pid").select("item_id", "post")


def loglik(vp: VotePatterns, model: DSModel) -> float:
    ll, _, _ = _em_statistics(vp.patterns, model, semi=False)
    return ll


# ---------------------------------------------------------------------------
# 50 unsupervised and 51 semi-supervised EM
# ---------------------------------------------------------------------------
@dataclass
class EMResult:
    model: DSModel          # parameters after the last M-step
    posterior: DataFrame    # (item_id, post): the last E-step (half a step behind model)
    ll_history: list[float]
    iterations: int


def _run_em(vp: VotePatterns, start: DSModel, max_iters: int, tol: float, laplace: float,
            mix_uniform: float, semi: bool) -> EMResult:
    model = start
    ll0, ps, cs = _em_statistics(vp.patterns, model, semi)
    hist = [ll0]
    post_model = model
    it = 0
    for it in range(1, max_iters + 1):
        post_model = model                      # E-step posterior that produced the new model
        model = m_step(model, ps, cs, laplace, mix_uniform)
        ll_new, ps, cs = _em_statistics(vp.patterns, model, semi)
        hist.append(ll_new)
        if abs(ll_new - hist[-2]) < tol:
            break
    model.ll_history = hist
    posterior = item_posterior(vp, post_model, semi=semi) if max_iters > 0 else \
        item_posterior(vp, start, semi=semi)
    return EMResult(model, posterior, hist, it)


def ds_unsupervised(votes: DataFrame, classes: list[str] | None = None, annotators: list[str] | None = None,
                    max_iters: int = 200, tol: float = 1e-7, laplace: float = 1e-2,
                    diagonal_bias: float = 0.6, prior_mix_uniform: float = 0.0,
                    items: DataFrame | None = None) -> EMResult:
    """Dawid-Skene EM without gold labels.  The start posterior does not matter here: the
    first E-step uses the smoothed vote priors and the diagonal-biased confusions."""
    classes = classes or class_list(votes)
    vp = build_patterns(votes, classes, annotators, items=items)
    pri = priors_from_patterns(vp, prior_mix_uniform)
    start = diagonal_start(classes, vp.annotators, pri, diagonal_bias)
    return _run_em(vp, start, max_iters, tol, laplace, prior_mix_uniform, semi=False)


def ds_semisupervised(votes: DataFrame, gold: DataFrame, classes: list[str] | None = None,
                      annotators: list[str] | None = None, max_iters: int = 200, tol: float = 1e-7,
                      laplace: float = 1e-2, init: str = "mv+priors", prior_mix_uniform: float = 0.0,
                      items: DataFrame | None = None) -> EMResult:
    """EM with gold items clamped to one-hot posteriors.  Priors come from the gold labels;
    confusions are seeded by one weighted count over the start posterior (gold one-hot,
    else the ``init`` vote shares, else the priors)."""
    classes = classes or class_list(votes)
    vp = build_patterns(votes, classes, annotators, items=items, gold=gold)
    pri = priors_from_gold(gold, classes, prior_mix_uniform)
    K = len(classes)
    # start posterior per pattern, expressed row-locally on the pattern votes
    votes_col = F.col("votes")
    def _count_of(k):
        return F.aggregate(votes_col, F.lit(0).cast("long"),
                           lambda acc, v: acc + F.when(v["l"] == k, v["cnt"]).otherwise(0))
    n = [_count_of(k) for k in range(K)]
    tot = sum(n[1:], n[0])
    if init == "uniform":
        mv = F.array(*[F.lit(1.0 / K)] * K)
    else:
        if init == "mv+priors":
            scr = [(n[k] / tot) * F.lit(max(float(pri[k]), FLOOR)) for k in range(K)]
        else:
            scr = [n[k] / tot for k in range(K)]
        s = sum(scr[1:], scr[0])
        den = F.when(s == 0, 1.0).otherwise(s)
        mv = F.array(*[x / den for x in scr])
    g = F.col("gold_idx")
    start_post = (F.when(g.isNotNull(), F.array(*[F.when(g == k, 1.0).otherwise(0.0) for k in range(K)]))
                  .when(F.size(votes_col) > 0, mv)
                  .otherwise(F.array(*[F.lit(float(p)) for p in pri])))
    ex = vp.patterns.select("w", start_post.alias("post"), F.explode("votes").alias("v"))
    rows = (ex.groupBy(F.col("v.a").alias("a"), F.col("v.l").alias("l"))
            .agg(*[F.sum(F.col("w") * F.col("v.cnt") * F.col("post")[k]).alias(f"s{k}") for k in range(K)])
            .collect())
    A = len(vp.annotators)
    cs = np.zeros((A, K, K))
    for r in rows:
        cs[r["a"], :, r["l"]] += np.array([r[f"s{k}"] for k in range(K)])
    conf = cs + laplace
    conf = conf / np.maximum(conf.sum(axis=2, keepdims=True), FLOOR)
    start = DSModel(list(classes), vp.annotators, pri, conf)
    return _run_em(vp, start, max_iters, tol, laplace, prior_mix_uniform, semi=True)


# ---------------------------------------------------------------------------
# 47 / 52 scoring with a given model (item level, no patterns needed)
# ---------------------------------------------------------------------------
def e_step(votes: DataFrame, model: DSModel, items: DataFrame | None = None, infer: bool = False) -> DataFrame:
    """Posterior of every item under a fixed model: ``(item_id, post)``.

    Votes are counted per (item, annotator, label), gathered per item (at most A*K entries
    per item) and scored row-locally.  ``infer=True`` applies the inference rules: votes by
    unknown annotators are ignored and items without votes get softmax(ln floor(prior)).
    """
    classes = model.classes
    v = _in_classes(votes.select("item_id", "annotator", "label"), classes)
    v = v.filter(F.col("annotator").isin(list(model.annotators)))
    amap = F.create_map(*[x for i, a in enumerate(model.annotators) for x in (F.lit(a), F.lit(i))])
    counted = (v.groupBy("item_id", "annotator", "label").agg(F.count(F.lit(1)).alias("cnt"))
               .select("item_id", F.struct(amap[F.col("annotator")].alias("a"),
                                           _class_index(classes).cast("int").alias("l"),
                                           F.col("cnt")).alias("v")))
    sig = counted.groupBy("item_id").agg(F.collect_list("v").alias("votes"))
    if items is not None:
        sig = items.select("item_id").distinct().join(sig, "item_id", "left")
    sig = sig.withColumn("votes", F.coalesce("votes", F.array().cast(
        "array<struct<a:int,l:int,cnt:bigint>>"))).withColumn("gold_idx", F.lit(None).cast("int"))
    return with_posterior(sig, model, infer=infer).select("item_id", "post")


def ds_infer(votes: DataFrame, model: DSModel, items: DataFrame | None = None,
             abstain_thresh: float | None = None) -> DataFrame:
    """Score items with a fitted model: ``(item_id, pred_label, confidence, top2_margin, post)``."""
    return hard_label(e_step(votes, model, items=items, infer=True), model.classes, abstain_thresh)


def label_conflicts(votes: DataFrame, order_col: str = "row_no") -> DataFrame:
    """Same item, same annotator, several distinct labels: one report row per conflict
    with the winning (first) label.  ``(item_id, annotator, n_labels, first_label)``."""
    g = (votes.groupBy("item_id", "annotator")
         .agg(F.count_distinct("label").alias("n_labels"),
              F.min_by("label", F.col(order_col)).alias("first_label")))
    return g.filter(F.col("n_labels") > 1)
