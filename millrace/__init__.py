"""Millrace: a Spark-native engine for job-posting data.

``sources`` read payloads, ``functions`` hold column expressions, ``operators``
DataFrame transformations, ``plans`` the registered queries, ``streaming`` the
incremental variants.  The optional subpackage for corpus work is imported by
nothing in here.
"""
