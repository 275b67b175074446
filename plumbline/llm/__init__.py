"""Training-data operators: ten corpus-scale operations on text tables.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` binds them to the tables of the engine.
"""

import sys

from pyspark import cloudpickle

# Workers need not have this package: its functions travel to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
