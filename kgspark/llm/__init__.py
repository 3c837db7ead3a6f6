"""Operators for preparing training text, each a DataFrame in and a DataFrame out.

Nothing else in the library imports this subpackage.  Its Python helpers that
run on executors are shipped by value, so a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
