"""flowsieve: Spark-native analytics for network-flow classification tables.

Plain functions over PySpark DataFrames, grouped by role:

* ``flowsieve.sources``   - scans (flow CSVs, packet logs, result texts, parquet)
* ``flowsieve.sinks``     - writers (predictions, metrics, reports, bucketed re-chunking, models)
* ``flowsieve.functions`` - column expressions (IPv4, labels, numbers, score arrays)
* ``flowsieve.operators`` - cleaning, sampling, statistics, metrics, classifiers, report parsing
* ``flowsieve.streaming`` - Structured Streaming packet/flow queries
* ``flowsieve.plans``     - adapters from the driver tables and the registered query catalog
"""

from flowsieve.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
