"""gradeflow: scoring free-text answers as Spark table work.

Every operator is a function from DataFrame to DataFrame.  Sub-packages:

* ``functions``  Column builders (no data movement)
* ``operators``  DataFrame transformations
* ``sources``    readers, writers and the model catalogue
* ``plans``      whole workflows: load, cross-validate, train, predict
* ``streaming``  Structured Streaming forms of the online computations
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
