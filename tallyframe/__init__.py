"""tallyframe: Spark DataFrame operators for long (sample, feature, count) tables.

Every public function takes and returns ``pyspark.sql.DataFrame`` (or ``Column``)
and is built from Spark joins, windows, aggregations and MLlib models.
"""

__version__ = "0.1.0"
