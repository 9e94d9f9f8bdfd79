"""Funnel and cohort reporting on Spark DataFrames.

Everything here takes and returns lazy DataFrames.  Nothing reads the clock: the
reporting date is always a parameter, so a report can be rebuilt for any day.
"""

from cohortline.session import configure

__all__ = ["configure"]
