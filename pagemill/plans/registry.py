"""Where queries and their oracles are registered, and how computed doubles are compared.

Computed doubles are rounded to six decimals on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def near(c):
    """Six decimals by the same arithmetic in both engines: their own rounding differs on ties."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5) / 1e6


def _near_sql(text: str) -> str:
    """round(x, 6) as near() writes it."""
    out, i = "", 0
    while (j := text.find("round(", i)) >= 0:
        k, depth = j + 6, 1
        while depth:
            depth += (text[k] == "(") - (text[k] == ")")
            k += 1
        inner = text[j + 6 : k - 1]
        out += text[i:j] + (f"(floor(({inner[:-3]})::DOUBLE * 1e6 + 0.5) / 1e6)" if inner.endswith(", 6") else text[j:k])
        i = k
    return out + text[i:]


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = _near_sql(oracle)
        return f

    return put


def r6(*names: str):
    return [near(n).alias(n) for n in names]


def rd(names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())
