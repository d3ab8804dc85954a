"""Training-data operators: token files, near-duplicates, extraction, quality, packing.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers by value: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
