"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from . import q_clean, q_eval, q_io, q_model, q_prepare, q_profile, q_runs  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
