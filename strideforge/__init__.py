"""Spark jobs for fleets of in-shoe pressure sensors."""

import sys

from pyspark import cloudpickle

# Ship the package's functions with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
