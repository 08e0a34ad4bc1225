"""Operators of a training-data pipeline (quality, near duplicates, leaks,
secrets, tokens, ...). Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python steps are sent to the workers by value: an executor needs no copy
# of this package.
register_pickle_by_value(sys.modules[__name__])
