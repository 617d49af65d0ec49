"""All registered queries."""

from rentlake.catalog import scalar_queries, source_queries, state_queries, stream_queries  # noqa: F401
from rentlake.catalog.registry import ORACLES, QUERIES

FLAGSHIP = "w4_digest_cut"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
