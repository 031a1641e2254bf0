"""corpuslens: corpus preparation, language statistics and questionnaire scoring on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
