"""The query catalogue: importing the section modules registers every query."""

from . import q_aggs, q_exprs, q_ext, q_filters, q_io, q_joins, q_streams, q_windows  # noqa: F401
from .oracle import with_fixtures
from .registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return {k: with_fixtures(v) for k, v in ORACLE.items()}
