"""questline: query log and catalog metadata in, questions answered in SQL out.

Every operator is ``f(DataFrame, ...) -> DataFrame`` or ``f(Column, ...) -> Column``
and stays lazy; the jobs in :mod:`questline.plans` decide where tables are written.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers bring their code along, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
