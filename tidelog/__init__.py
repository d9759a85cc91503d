"""Analytics on user-activity events, written as Spark DataFrame jobs.

Layers: ``catalogue`` and ``schema`` (data model), ``functions`` (column
expressions), ``sources`` (readers, writers, layouts, generators),
``operators`` (DataFrame -> DataFrame), ``plans`` (named queries) and
``streaming`` (Structured Streaming jobs).
"""
