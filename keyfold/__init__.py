"""keyfold: per-key state on Spark, in batch and in streams.

Every operator takes a DataFrame of records with three columns:

* ``seq``   BIGINT, unique; the order in which records count
* ``key``   any type Spark can group by, a struct included
* ``value`` BIGINT
"""
