"""The library's operators bound to the driver's tables, with DuckDB SQL for comparison."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
