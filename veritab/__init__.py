"""Evidence-based discovery on tables, event logs and text corpora, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Small Python helpers travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
