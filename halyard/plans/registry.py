"""All registered queries of the engine's own operators."""

import halyard.plans.geometry  # noqa: F401  (registers its queries)
import halyard.plans.optimal  # noqa: F401
from halyard.plans.queries import ORACLE_SQL, QUERIES

ENTRY = "stopping_step_linear"
__all__ = ["ENTRY", "ORACLE_SQL", "QUERIES"]
