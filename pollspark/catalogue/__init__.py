"""Registered queries: every operator on the driver's tables, with equivalent SQL where it exists.

The tables carry no polls, so they stand in for them: an order is a poll, its priority the source,
the part type the party, summed quantities the votes, and line items the posterior draws of the
cell (14-day period, part type).
"""

from __future__ import annotations

from pollspark.catalogue import (  # noqa: F401  (import registers the queries)
    checks, drawsets, files, jobs, pages, polls, published, series, streams, tables,
)
from pollspark.catalogue.base import REGISTRY

__all__ = ["REGISTRY"]
