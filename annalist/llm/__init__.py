"""Operators of a training-data pipeline: tokens, near duplicates, classifiers, packing.

Functions that Spark runs on executors are sent with the job, so executors need only the
public libraries and no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
