"""Named queries over the driver tables, each with the SQL it must equal.

The SQL is written from the meaning of the operator, not from its Spark plan.
"""

from workload import binning, evaluation, profiling, rows, transforms, trees  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
