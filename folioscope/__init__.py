"""Folioscope: document-unit analytics on PySpark.

Noisy, layout-annotated pages become typed blocks, blocks become citable units, and units are
cleaned, matched and measured. Operators are ``DataFrame -> DataFrame`` or ``Column -> Column``
functions; Catalyst plans them.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
