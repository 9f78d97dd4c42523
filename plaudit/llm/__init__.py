"""Operators of a training-data pipeline over documents, pages, embeddings and chats.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that their Python path need not hold this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
