"""EM to convergence, as registered, against the same equations item by item."""

import numpy as np
from test_consensus import brute_em

import __spark_entry__ as E
from consensa.plans.fixtures import lineitem_votes

SF = "/root/testdata/sf0.001"


def test_converged_query_matches_brute_force(spark):
    got = E.queries()["ds_unsupervised_converged"](spark, SF).collect()
    votes = [(r["item_id"], r["annotator"], r["label"]) for r in lineitem_votes(spark, SF).collect()]
    classes, annotators = sorted({v[2] for v in votes}), sorted({v[1] for v in votes})
    post, _, _, hist = brute_em(votes, classes, annotators, 200, tol=1e-7)
    assert len(hist) > 3 and {r["item_id"] for r in got} == set(post)
    for r in got:
        p = post[r["item_id"]]
        np.testing.assert_allclose(r["confidence"], p.max(), atol=1e-6)
        first, second = np.sort(p)[::-1][:2]
        if first - second > 1e-6:
            assert r["pred_label"] == classes[int(p.argmax())]
