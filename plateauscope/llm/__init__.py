"""Operators for preparing training data: personal data, decontamination, near-duplicates,
main-text extraction, tokens, quality and toxicity. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
