"""Small DuckDB SQL fragments mirroring the text helpers (used by the oracles only)."""

from __future__ import annotations

from consensa.functions.text import WS_CLASS


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, {lit(f'^{WS_CLASS}+|{WS_CLASS}+$')}, '', 'g')"


def collapse_ws(e: str) -> str:
    return strip_ws(f"regexp_replace({e}, {lit(f'{WS_CLASS}+')}, ' ', 'g')")


def clean_text(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'))"


def str_list(xs: list[str]) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def vectorizer_tokens(clean_expr: str) -> str:
    return f"list_filter(string_split({clean_expr}, ' '), lambda t: length(t) >= 2)"


def ngram_rows(tokens_expr: str, key_cols: str, src: str, n_min: int, n_max: int) -> str:
    """Rows (key..., n, pos, gram) of all n-grams of a token list column."""
    parts = []
    for n in range(n_min, n_max + 1):
        parts.append(
            f"SELECT {key_cols}, {n} AS n, CAST(i AS INTEGER) AS pos, "
            f"array_to_string(list_slice(tok, i, i + {n - 1}), ' ') AS gram "
            f"FROM (SELECT {key_cols}, {tokens_expr} AS tok FROM {src}) s, "
            f"LATERAL (SELECT unnest(range(1, len(tok) - {n - 1} + 1)) AS i) g")
    return " UNION ALL ".join(parts)
