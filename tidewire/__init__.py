"""tidewire: Spark-native news-article analytics.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, windows, joins and aggregations, so Catalyst plans it and the
work runs distributed.  Python only runs inside tasks where no built-in
expression exists (unzip of raw drops, Unicode NFC, HTML entities), and then
through Arrow-batched ``pandas_udf`` / ``mapInPandas``.
"""

__version__ = "0.1.0"
