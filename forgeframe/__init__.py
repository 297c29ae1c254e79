"""forgeframe: DataFrame operators for the data of a code-hosting and collaboration site.

Sub-packages: ``sources`` (tables, schemas, JSON Lines), ``functions`` (scalar and text
functions as Columns), ``operators`` (filters, joins, aggregates, paging, mutations),
``streaming`` (feed fan-out, routing, queues), ``plans`` (registered queries with their
SQL oracles). ``llm`` is separate: nothing here imports it.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# workers need not have this package: functions that run there travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
