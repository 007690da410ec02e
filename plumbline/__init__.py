"""plumbline: checking, linking and analysing tables at scale with PySpark."""

import sys

from pyspark import cloudpickle

# functions used inside tasks travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
