"""Training-data pipeline operators.

Each module holds one operator with a general interface; ``queries`` registers
the production runs.  Nothing outside this package (and the pipeline script)
imports it.
"""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
