"""Operators of a training-data pipeline: deduplication, filtering, tokens, shards.

Nothing outside this package imports it. Functions that run in Python workers
are pickled with the job, so executors need numpy, xxhash and the tokenizer
libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
