"""paperweft: document analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel with the plan, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
