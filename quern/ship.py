"""Python functions of this package travel to executors by value.

A cluster's workers need not have the package on their path then.
"""

import sys

from pyspark import cloudpickle


def by_value() -> None:
    cloudpickle.register_pickle_by_value(sys.modules["quern"])
