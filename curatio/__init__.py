"""curatio: Spark-native building, curation and audit of language-model datasets.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (or a ``Column``)
and builds a lazy logical plan; nothing is collected to the driver except
small, size-checked lookup lists.
"""

__version__ = "0.1.0"
