"""Training-data operators: deduplication, decontamination, language, mixing, chat, URLs.

Functions that run inside tasks travel with them, so executors need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
