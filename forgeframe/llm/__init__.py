"""Data operators for language-model corpora: one module for each, nothing else imports them.

Each module has a general operator (a DataFrame in, a DataFrame or files out); ``queries``
has the thin ``opN_`` queries that apply them to the whole tables and return digest columns.
"""

import sys

from pyspark import cloudpickle

# workers need not have this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
