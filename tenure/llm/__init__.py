"""Training-data operators: classifiers, near-duplicate search, mixing, language models, tokenizers."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
