"""docweave: document-graph analytics and training-data operators on Spark DataFrames.

Importing the package registers it for pickling by value, so Python stages run on executors that do
not have the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
