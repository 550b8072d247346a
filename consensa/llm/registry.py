"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import importlib

_MODULES = ["quality_rules", "suffix_dedup", "line_dedup", "url_filter", "chat_format", "html_extract", "packing", "quality_classifier",
            "near_dedup", "decontaminate", "whitening", "personal_data", "token_alignment"]


def _gather(kind: str) -> dict:
    out = {}
    for m in _MODULES:
        out.update(getattr(importlib.import_module(f"consensa.llm.{m}"), kind))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLE")
