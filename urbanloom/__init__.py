"""Analytics over three-dimensional city data, planned by Spark.

Point clouds, rasters, footprints, road graphs, trees, meshes and sensor
readings are ordinary DataFrames; operators are functions from DataFrames to
DataFrames, so Catalyst sees one plan from scan to result.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel with the plan, so workers need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
