"""Training-data operators: extraction, language, licences, near copies, tokens, shards, archives.

Python functions that run inside tasks are pickled by value, so executors need
no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
