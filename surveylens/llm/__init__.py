"""Training-data operators: quality, licences, mixing, packing, fingerprints, token
counts, near duplicates, vector search, secrets and page text.

Nothing else in the library imports this subpackage.  ``queries.py`` registers one
query per operator.
"""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors by value, so that a cluster need not
# have the library installed on every machine
cloudpickle.register_pickle_by_value(sys.modules[__name__])
