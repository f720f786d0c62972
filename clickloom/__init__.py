"""clickloom: Spark-native processing of recorded user-interaction events.

Every operator is a function DataFrame -> DataFrame built from Spark SQL
expressions, windows, joins and aggregations.  Order-dependent work keyed by
recording runs through ``clickloom.plans.ordered``, which splits each
recording into bounded ``_chunk`` ranges so that one enormous recording never
lands in a single task.
"""

__version__ = "0.1.0"
