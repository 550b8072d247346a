"""All registered queries and oracles, gathered from the plan modules."""

from __future__ import annotations

import importlib

_MODULES = ["consensa.plans.consensus_queries", "consensa.plans.text_queries", "consensa.plans.mining_queries",
            "consensa.plans.vector_queries", "consensa.plans.cluster_queries",
            "consensa.plans.embedding_queries", "consensa.plans.io_queries"]


def _load():
    qs, os_ = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        qs.update(mod.QUERIES)
        os_.update(mod.ORACLE)
    return qs, os_


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
