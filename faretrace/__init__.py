"""Price-trajectory analytics on Spark DataFrames.

Items are re-priced over time until an expiry date. Every public operator takes
and returns a lazy ``DataFrame`` built from native expressions; see README.md.
"""

from faretrace.params import DEFAULTS, Params
from faretrace.plans.trajectory import Trajectory

__all__ = ["DEFAULTS", "Params", "Trajectory"]
