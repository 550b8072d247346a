"""consensa: annotation consensus and text mining as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregations and windows.  Iterative algorithms (EM, connected
components, topic merging) are driver loops over DataFrames that only ever pull
model-sized state (a few numbers per class/annotator) to the driver.
"""

__version__ = "0.1.0"
