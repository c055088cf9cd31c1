"""tablewright: Spark-native table profiling, cleaning, feature preparation and
model evaluation.

Every operator takes and returns :class:`pyspark.sql.DataFrame` objects and is
expressed with DataFrame / SQL / Spark ML primitives so the heavy lifting runs
distributed.  Driver-side Python only ever sees small decision tables
(per-column statistics, fitted category maps, bracket histograms).
"""

__version__ = "0.1.0"
