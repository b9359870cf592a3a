"""Operations of a training-data pipeline: ten operators over documents and pages.

Nothing else in the library imports this subpackage. Python functions that run in
tasks are shipped by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
