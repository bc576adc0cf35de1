"""Operators for building training corpora from screened documents.

Each module holds one operator; ``catalogue`` maps the given tables to them. Task
functions of this package travel with the tasks by value, so executors need NumPy,
Arrow and the libraries a module names, but not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
