"""Document-structure analytics over whole collections of books, as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the functions themselves: no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
