"""Field-evidence and impact analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python tasks (the provider job, keyed photo state) carry this package's code with them,
# so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
