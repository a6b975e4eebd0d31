"""Operators for corpora that train language models. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Tasks get these functions with the job, whether or not the executors have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
