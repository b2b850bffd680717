"""Training-data operators: tokenizing, archives, deduplication, decontamination, filtering.

Functions sent to executors are pickled by value, so executors need numpy, pyarrow and the
like, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
