"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
