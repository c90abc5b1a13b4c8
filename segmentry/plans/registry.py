"""All queries of the library, and the SQL of those that SQL can express."""

from __future__ import annotations

from segmentry.plans import labels, measures, models, trajectories  # noqa: F401
from segmentry.plans.views import QUERIES, SQL  # noqa: F401
