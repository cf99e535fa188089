"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables. Computed columns carry the same alias in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all():
    # Importing the plan modules fills REGISTRY.
    from quarry.plans import q_corpus, q_retrieve  # noqa: F401
    for mod in ("q_tables", "q_ledger", "q_compare", "q_analyze", "q_multimodal", "q_evals",
                "q_sources", "q_streaming", "q_conversations", "q_build"):
        __import__(f"quarry.plans.{mod}")
    return REGISTRY
