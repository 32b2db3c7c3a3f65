"""Queries of the panel operators and their SQL."""

from __future__ import annotations

from .queries import QUERIES, SQL
from .queries import indicators as _indicators  # noqa: F401
from .queries import market as _market  # noqa: F401
from .queries import jobs as _jobs  # noqa: F401
from .queries import portfolio as _portfolio  # noqa: F401
from .queries import stats as _stats  # noqa: F401
from .queries import structure as _structure  # noqa: F401
from .queries import reports as _reports  # noqa: F401  (its SQL builds on that of the others)
from .queries import streams as _streams  # noqa: F401
from .queries import stored as _stored  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
