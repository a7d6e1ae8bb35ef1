"""Training-data sharding and loading as Spark jobs.

Samples are a DataFrame; shard assignment, distribution over workers, batching and the metrics around
them are DataFrame operators; shard files are Spark data sources.
"""

import sys

from pyspark import cloudpickle

# Ship kernels and data sources to executors by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
