"""strata: a Spark-native medallion warehouse.

Raw CRM/ERP extracts land in a bronze layer, are cleaned and historised into
silver, and are shaped into a star schema (two dimensions, one fact) with two
reporting views in gold.  Every step is a ``DataFrame -> DataFrame`` function,
so the same code runs in a unit test, on one machine and on a cluster.
"""

__all__ = ["session", "schemas"]
