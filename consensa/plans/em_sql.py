"""DuckDB oracle text for the EM operators: a fixed number of iterations unrolled as CTEs.

Written directly from the update equations (priors, confusions, E-step, M-step,
log-likelihood) over long tables; independent of the Spark pattern plan.
"""

from __future__ import annotations


def _values(rows: list[tuple], cols: str) -> str:
    body = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({cols})"


def em_ctes(votes_sql: str, classes: list[str], annotators: list[str], iterations: int,
            gold_sql: str | None = None, laplace: float = 0.01, diagonal_bias: float = 0.6,
            init: str = "mv+priors") -> list[str]:
    """CTE list defining prior_i, conf_i (i = 0..iterations), post_i (i = 1..iterations)
    and ll_i (i = 0..iterations)."""
    K = len(classes)
    semi = gold_sql is not None
    ctes = [
        f"cls AS (SELECT * FROM {_values([(c, i) for i, c in enumerate(classes)], 'label, ord')})",
        f"ann AS (SELECT * FROM {_values([(a,) for a in annotators], 'annotator')})",
        f"vraw AS ({votes_sql})",
        "v AS (SELECT item_id, annotator, label FROM vraw WHERE label IN (SELECT label FROM cls))",
        "items AS (SELECT DISTINCT item_id FROM vraw)",
        "grid AS (SELECT a.annotator, t.label AS t, o.label AS o FROM ann a, cls t, cls o)",
    ]
    if not semi:
        ctes += [
            "vc AS (SELECT label, count(*) AS n FROM v GROUP BY label)",
            f"prior_0 AS (SELECT c.label, CASE WHEN (SELECT count(*) FROM v) > 0 "
            f"THEN (coalesce(vc.n, 0) + 1.0) / ((SELECT count(*) FROM v) + {K}) ELSE 1.0 / {K} END AS p "
            f"FROM cls c LEFT JOIN vc ON vc.label = c.label)",
            f"conf_0 AS (SELECT annotator, t, o, CASE WHEN t = o THEN {diagonal_bias} "
            f"ELSE {(1.0 - diagonal_bias) / max(K - 1, 1)!r} END AS p FROM grid)",
        ]
    else:
        ctes += [
            f"graw AS ({gold_sql})",
            "gold AS (SELECT g.item_id, g.label FROM graw g JOIN items USING (item_id))",
            "gc AS (SELECT label, count(*) AS n FROM graw GROUP BY label)",
            f"prior_0 AS (SELECT c.label, CASE WHEN (SELECT count(*) FROM graw) > 0 "
            f"THEN (coalesce(gc.n, 0) + 1.0) / ((SELECT count(*) FROM graw) + {K}) ELSE 1.0 / {K} END AS p "
            f"FROM cls c LEFT JOIN gc ON gc.label = c.label)",
            # start posterior: gold one-hot, else vote shares x floored prior, else priors
            "ivc AS (SELECT v.item_id, c.label AS t, sum(CASE WHEN v.label = c.label THEN 1 ELSE 0 END) AS n, "
            "count(*) AS tot FROM v, cls c GROUP BY v.item_id, c.label)",
        ]
        if init == "mv+priors":
            score = "(CAST(ivc.n AS DOUBLE) / ivc.tot) * greatest(p0.p, 1e-12)"
        elif init == "mv":
            score = "(CAST(ivc.n AS DOUBLE) / ivc.tot)"
        else:
            score = f"1.0 / {K}"
        ctes += [
            f"mv AS (SELECT ivc.item_id, ivc.t, {score} AS s FROM ivc JOIN prior_0 p0 ON p0.label = ivc.t)",
            "mvn AS (SELECT item_id, t, s / CASE WHEN sum(s) OVER (PARTITION BY item_id) = 0 THEN 1.0 "
            "ELSE sum(s) OVER (PARTITION BY item_id) END AS p FROM mv)",
            "start AS ("
            "SELECT i.item_id, c.label AS t, CASE WHEN g.item_id IS NOT NULL THEN "
            "(CASE WHEN g.label = c.label THEN 1.0 ELSE 0.0 END) "
            "WHEN m.p IS NOT NULL THEN m.p ELSE p0.p END AS p "
            "FROM items i CROSS JOIN cls c LEFT JOIN gold g ON g.item_id = i.item_id "
            "LEFT JOIN mvn m ON m.item_id = i.item_id AND m.t = c.label "
            "JOIN prior_0 p0 ON p0.label = c.label)",
        ]
        ctes += _mstep_conf("start", "conf_0", laplace)

    for i in range(iterations + 1):
        ctes += _estep(i, semi)
        if i < iterations:
            ctes += [
                f"prior_{i + 1} AS (SELECT t AS label, sum(p) / (SELECT sum(p) FROM post_{i + 1}) AS p "
                f"FROM post_{i + 1} GROUP BY t)",
            ]
            ctes += _mstep_conf(f"post_{i + 1}", f"conf_{i + 1}", laplace)
    return ctes


def _mstep_conf(post: str, name: str, laplace: float) -> list[str]:
    return [
        f"{name}_s AS (SELECT v.annotator, p.t, v.label AS o, sum(p.p) AS s "
        f"FROM v JOIN {post} p ON p.item_id = v.item_id GROUP BY v.annotator, p.t, v.label)",
        f"{name} AS (SELECT g.annotator, g.t, g.o, ({laplace} + coalesce(s.s, 0)) / "
        f"greatest(sum({laplace} + coalesce(s.s, 0)) OVER (PARTITION BY g.annotator, g.t), 1e-12) AS p "
        f"FROM grid g LEFT JOIN {name}_s s ON s.annotator = g.annotator AND s.t = g.t AND s.o = g.o)",
    ]


def _estep(i: int, semi: bool) -> list[str]:
    """Scores under (prior_i, conf_i) -> post_{i+1} and ll_i."""
    out = [
        f"sc_{i} AS (SELECT v.item_id, c.label AS t, sum(ln(greatest(cf.p, 1e-12))) AS sv "
        f"FROM v CROSS JOIN cls c JOIN conf_{i} cf ON cf.annotator = v.annotator AND cf.t = c.label "
        f"AND cf.o = v.label GROUP BY v.item_id, c.label)",
        f"s_{i} AS (SELECT sc.item_id, sc.t, sc.sv + ln(greatest(pr.p, 1e-12)) AS s "
        f"FROM sc_{i} sc JOIN prior_{i} pr ON pr.label = sc.t)",
        f"m_{i} AS (SELECT item_id, max(s) AS m FROM s_{i} GROUP BY item_id)",
        f"z_{i} AS (SELECT s.item_id, m.m, sum(exp(s.s - m.m)) AS z FROM s_{i} s JOIN m_{i} m USING (item_id) "
        f"GROUP BY s.item_id, m.m)",
        f"ll_{i} AS (SELECT {i} AS iteration, sum(m + ln(z)) + coalesce((SELECT count(*) FROM items "
        f"WHERE item_id NOT IN (SELECT item_id FROM v)) * ln((SELECT sum(p) FROM prior_{i})), 0) AS loglik FROM z_{i})",
    ]
    soft = f"exp(s.s - z.m) / z.z"
    if semi:
        body = (f"SELECT i.item_id, c.label AS t, CASE WHEN g.item_id IS NOT NULL THEN "
                f"(CASE WHEN g.label = c.label THEN 1.0 ELSE 0.0 END) "
                f"WHEN s.item_id IS NOT NULL THEN {soft} ELSE pr.p END AS p "
                f"FROM items i CROSS JOIN cls c LEFT JOIN gold g ON g.item_id = i.item_id "
                f"LEFT JOIN s_{i} s ON s.item_id = i.item_id AND s.t = c.label "
                f"LEFT JOIN z_{i} z ON z.item_id = i.item_id JOIN prior_{i} pr ON pr.label = c.label")
    else:
        body = (f"SELECT i.item_id, c.label AS t, CASE WHEN s.item_id IS NOT NULL THEN {soft} "
                f"ELSE pr.p END AS p FROM items i CROSS JOIN cls c "
                f"LEFT JOIN s_{i} s ON s.item_id = i.item_id AND s.t = c.label "
                f"LEFT JOIN z_{i} z ON z.item_id = i.item_id JOIN prior_{i} pr ON pr.label = c.label")
    out.append(f"post_{i + 1} AS ({body})")
    return out


def hard_label_sql(post: str, classes: list[str], abstain: float | None = None) -> str:
    """Wide prediction rows from a long posterior CTE ``post(item_id, t, p)``."""
    pcols = ", ".join(f"round(max(CASE WHEN t = '{c}' THEN p END), 6) AS p_{c}" for c in classes)
    label = "r1.t"
    if abstain is not None:
        label = f"CASE WHEN r1.p < {abstain} THEN 'ABSTAIN' ELSE r1.t END"
    second = "coalesce(r2.p, 0.0)"
    return f"""
    ranked AS (SELECT p.item_id, p.t, p.p, row_number() OVER (PARTITION BY p.item_id ORDER BY p.p DESC, c.ord) AS rk
               FROM {post} p JOIN cls c ON c.label = p.t),
    wide AS (SELECT item_id, {pcols} FROM {post} GROUP BY item_id)
    SELECT w.*, {label} AS pred_label, round(r1.p, 6) AS confidence, round(r1.p - {second}, 6) AS top2_margin
    FROM wide w JOIN ranked r1 ON r1.item_id = w.item_id AND r1.rk = 1
    LEFT JOIN ranked r2 ON r2.item_id = w.item_id AND r2.rk = 2
    """


def infer_ctes(model_i: int) -> list[str]:
    """One inference E-step under (prior_i, conf_i): unknown annotators ignored, items without
    votes get softmax(ln floor(prior))."""
    i = model_i
    return [
        f"isc AS (SELECT v.item_id, c.label AS t, sum(ln(greatest(cf.p, 1e-12))) AS sv "
        f"FROM v CROSS JOIN cls c JOIN conf_{i} cf ON cf.annotator = v.annotator AND cf.t = c.label "
        f"AND cf.o = v.label GROUP BY v.item_id, c.label)",
        f"is_ AS (SELECT i.item_id, c.label AS t, coalesce(sc.sv, 0) + ln(greatest(pr.p, 1e-12)) AS s "
        f"FROM items i CROSS JOIN cls c LEFT JOIN isc sc ON sc.item_id = i.item_id AND sc.t = c.label "
        f"JOIN prior_{i} pr ON pr.label = c.label)",
        "im AS (SELECT item_id, max(s) AS m FROM is_ GROUP BY item_id)",
        "iz AS (SELECT s.item_id, sum(exp(s.s - im.m)) AS z FROM is_ s JOIN im USING (item_id) GROUP BY s.item_id)",
        "ipost AS (SELECT s.item_id, s.t, exp(s.s - im.m) / iz.z AS p FROM is_ s JOIN im USING (item_id) "
        "JOIN iz USING (item_id))",
    ]
