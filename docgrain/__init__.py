"""Document-retrieval analytics and corpus preparation on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors inside the task, so that a
# cluster needs no copy of it on its Python path.
register_pickle_by_value(sys.modules[__name__])
