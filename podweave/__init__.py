"""Container-log analytics as Spark DataFrame operators.

Lines of pod logs (CRI text or Docker JSON) become typed events, events become size-bounded batches, batches pass a
token bucket per stream, and the admitted events leave as text, Parquet or binary frames.
"""

import sys

from pyspark import cloudpickle

# Task functions and data sources of this package travel inside the job, so the executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
