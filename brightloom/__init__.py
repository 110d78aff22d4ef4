"""Event analytics and document retrieval as plain Spark jobs.

Every public function maps DataFrames (or Columns) to DataFrames (or Columns);
nothing keeps hidden session state and every clock is an explicit ``as_of``.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
