"""Retail transaction analytics expressed as Spark jobs.

Layers, bottom up:

* ``schema``      column names, types and fixed word lists
* ``sources``     readers and writers (raw sheets, the ``sales`` table, CSV results)
* ``functions``   column expressions
* ``operators``   DataFrame-in / DataFrame-out building blocks
* ``plans``       the reports, the load, the forecast and the segmentation
"""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
