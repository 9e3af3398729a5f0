"""folio: document-corpus analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Workers need no copy of this package: functions that Spark ships carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
