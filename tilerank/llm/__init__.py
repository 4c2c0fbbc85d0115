"""Operators that prepare text corpora for the training of language models."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors travel with their code, so that the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
