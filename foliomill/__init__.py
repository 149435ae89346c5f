"""foliomill: document-layout, edit-log and redaction-audit analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
