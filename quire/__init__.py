"""quire: versioned nested-document analytics as plain Spark jobs.

Documents, write logs and people live in DataFrames; every operator is a
DataFrame -> DataFrame function that Catalyst plans and Spark distributes.
"""

from quire.session import get_spark, shared_path

__all__ = ["get_spark", "shared_path"]
