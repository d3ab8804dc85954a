"""All registered queries of the reference's operators, by name."""

from __future__ import annotations

from quarry.plans import chat, corpus, evidence, io, profile, retrieval, segments, state, streams, texts  # noqa: F401
from quarry.plans.common import REGISTRY, Query


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
