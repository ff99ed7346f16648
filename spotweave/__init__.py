"""spotweave: Spark jobs that place, schedule, serve and evaluate in-video ads."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
