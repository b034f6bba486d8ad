"""clusterlens: cluster utilisation analytics on Spark.

Modules: ``sources`` (read/write), ``functions`` (column functions),
``operators`` (parse, clean, series, profiles, reports, forecast, capacity),
``streaming`` (incremental ingest), ``plans`` (registered queries and their
SQL twins), ``session`` (session, scratch folder, cluster settings).
"""

__version__ = "0.1.0"
