"""All named queries."""

from wayline.plans import normalize_queries  # noqa: F401
from wayline.plans import geometry_queries  # noqa: F401
from wayline.plans import frame_queries  # noqa: F401
from wayline.plans import join_queries  # noqa: F401
from wayline.plans import report_queries  # noqa: F401
from wayline.plans import score_queries  # noqa: F401
from wayline.plans import source_queries  # noqa: F401
from wayline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
